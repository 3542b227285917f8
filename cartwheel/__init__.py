"""cartwheel: commerce analytics, directory reads, table maintenance and event
payload jobs expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
