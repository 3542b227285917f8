import datetime as dt
import random

from cartwheel.llm import url_lists as u

D = dt.date
ENTRIES = "list_name string, action string, pattern string, change string, changed_on date"


def verdicts(llm, captures, entries):
    caps = llm.createDataFrame(captures, "id long, url string, fetched_on date")
    out = u.as_of_join(caps, llm.createDataFrame(entries, ENTRIES))
    return {r["id"]: (r["verdict"], r["list_name"], r["pattern"]) for r in out.collect()}


def test_entries_hold_from_their_date_to_the_next_change(llm):
    entries = [("l", "block", "bad.org", "add", D(2024, 1, 10)), ("l", "block", "bad.org", "remove", D(2024, 2, 1)),
               ("l", "block", "bad.org", "add", D(2024, 6, 1))]
    caps = [(k, "http://x.bad.org/a", d) for k, d in enumerate([D(2024, 1, 9), D(2024, 1, 10), D(2024, 1, 31), D(2024, 2, 1), D(2024, 6, 1), D(2026, 1, 1)])]
    got = verdicts(llm, caps, entries)
    assert [got[k][0] for k in range(6)] == [None, "block", "block", None, "block", "block"]


def test_most_specific_pattern_wins_and_allow_beats_block(llm):
    day = D(2024, 1, 1)
    entries = [("a", "block", "org", "add", day), ("b", "allow", "good.org", "add", day), ("c", "block", "good.org/bad", "add", day),
               ("d", "allow", "tie.net", "add", day), ("e", "block", "tie.net", "add", day), ("f", "block", "good.org/bad/x/y", "add", day)]
    caps = [(k, url, D(2024, 3, 1)) for k, url in enumerate([
        "http://other.org", "https://u:p@WWW.Good.org:8080/fine", "http://good.org//bad/1?q=/x", "http://tie.net/", "http://good.org/badly",
        "http://good.org/bad/x/y/z#f", "http://notgood.org/", "ftp:nothing", "http://org./"])]
    got = verdicts(llm, caps, entries)
    assert [got[k][0] for k in range(9)] == ["block", "allow", "block", "allow", "allow", "block", "block", None, "block"]
    assert got[5][2] == "good.org/bad/x/y" and got[4][2] == "good.org"


def test_equals_brute_force(llm):
    rnd = random.Random(3)
    hosts = ["a.x.com", "x.com", "b.x.com", "y.net", "c.y.net"]
    entries = [(rnd.choice("lm"), rnd.choice(["block", "allow"]), rnd.choice(hosts) + rnd.choice(["", "/p", "/p/q"]), rnd.choice(["add", "remove"]),
                D(2024, 1, 1) + dt.timedelta(rnd.randrange(300))) for _ in range(120)]
    caps = [(k, f"http://{rnd.choice(hosts)}/{rnd.choice(['', 'p', 'p/q', 'q'])}", D(2024, 1, 1) + dt.timedelta(rnd.randrange(320))) for k in range(400)]
    got = verdicts(llm, caps, entries)
    daily = {}
    for name, action, pattern, change, day in entries:
        daily.setdefault((name, action, pattern), {}).setdefault(day, set()).add(change)
    for k, url, day in caps:
        host, segs = url.split("/")[2], [s for s in url.split("/")[3:] if s]
        best = []
        for (name, action, pattern), changes in daily.items():
            past = [d for d in changes if d <= day]
            if not past or "add" not in changes[max(past)]:
                continue
            p_host, *p_segs = pattern.split("/")
            if (host == p_host or host.endswith("." + p_host)) and segs[:len(p_segs)] == p_segs:
                best.append((-p_host.count("."), -len(p_segs), action, name, pattern))
        want = (min(best)[2], min(best)[3], min(best)[4]) if best else (None, None, None)
        assert got[k] == want


def test_nulls_repeats_and_clashing_columns(llm):
    caps = llm.createDataFrame([(1, "http://bad.org", D(2024, 1, 5), "h", "v"), (1, "http://bad.org", D(2024, 1, 5), "h", "v"), (2, None, D(2024, 1, 5), None, None),
                                (3, "http://bad.org", None, None, None), (4, "", D(2024, 1, 5), None, None), (None, "http://bad.org/" + "a/" * 5000, D(2024, 1, 6), None, None)],
                               "page_id long, url string, fetched_on date, host string, verdict string")
    entries = llm.createDataFrame([("l", "block", "bad.org", "add", D(2024, 1, 1)), ("l", "block", "bad.org", "add", D(2024, 1, 1)),
                                   (None, "block", "x", "add", D(2024, 1, 1)), ("l", None, "x", "add", D(2024, 1, 1)), ("l", "block", None, "add", D(2024, 1, 1)),
                                   ("l", "block", "bad.org", "add", None)], ENTRIES)
    rows = u.as_of_join(caps, entries).collect()
    assert sorted((r["page_id"] or -1, r["verdict"]) for r in rows if r["verdict"]) == [(-1, "block"), (1, "block"), (1, "block")]
    assert len(rows) == 6 and {r["capture_host"] for r in rows} == {"h", None}


def test_empty_tables(llm):
    caps = llm.createDataFrame([(1, "http://a.b", D(2024, 1, 5))], "page_id long, url string, fetched_on date")
    none = llm.createDataFrame([], ENTRIES)
    assert [r["verdict"] for r in u.as_of_join(caps, none).collect()] == [None]
    assert u.as_of_join(caps.where("false"), none).count() == 0


def test_no_python_in_the_plan(llm):
    from cartwheel.llm.queries import op1_url_lists
    plan = op1_url_lists(llm, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_names_in_any_case_keep_their_values(llm):
    caps = llm.createDataFrame([(1, "http://bad.org", D(2024, 1, 5), "h", "c", "u")], "page_id long, url string, fetched_on date, Host string, capture_Host string, _URL string")
    entries = llm.createDataFrame([("l", "block", "bad.org", "add", D(2024, 1, 1))], ENTRIES)
    (r,) = u.as_of_join(caps, entries).collect()
    assert (r["_capture_Host"], r["capture_Host"], r["capture__URL"], r["host"], r["verdict"]) == ("h", "c", "u", "bad.org", "block")
