import numpy as np

from cartwheel.llm import embedding_dedup as e


def brute_force(rows, threshold=0.93):
    ok = [(i, l, np.asarray(v, float)) for i, v, l in rows if i is not None and l is not None and v is not None and len(v) and None not in v
          and np.isfinite(np.asarray(v, float)).all() and np.any(np.asarray(v, float) != 0)]
    top = {i: i for i, _, _ in rows}
    links = {i: 0 for i, _, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(ok)):
        for b in range(a + 1, len(ok)):
            (i, l, x), (j, k, y) = ok[a], ok[b]
            if l == k and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                links[i] += 1
                links[j] += 1
                p, q = sorted((find(i), find(j)))
                top[q] = p
    return links, {i: find(i) for i in top}


def clustered(n, dims, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 12), dims))
    return [[float(x) for x in centres[rng.integers(len(centres))] + spread * rng.normal(size=dims)] for _ in range(n)]


def test_links_of_several_shards_are_found_and_none_invented(llm):
    vectors = clustered(900, 16, 1, 0.25)
    rows = [(i, v, i % 2) for i, v in enumerate(vectors)]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    links, component = brute_force(rows)
    got = {r["vec_id"]: r for r in e.near_duplicates(df, shard_size=120).collect()}
    assert sum(links.values()) > 1000
    assert all(got[i]["n_links"] <= links[i] for i in links)
    assert sum(r["n_links"] for r in got.values()) >= 0.98 * sum(links.values())
    assert sum(got[i]["component_id"] != component[i] for i in component) <= 0.02 * len(component)


def test_edge_rows(llm):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1, 5), (1, [1.0, 0.0], 1, 5), (2, [1.0, 0.01], 1, 5), (3, [1.0, 0.0], 2, 5), (4, [1.0, 0.0], None, 5), (5, None, 1, 5),
            (6, [0.0, 0.0], 1, 5), (7, [nan, 1.0], 1, 5), (8, [None, 1.0], 1, 5), (9, [], 1, 5), (10, [1.0, 0.0, 0.0], 1, 5), (None, [1.0, 0.0], 1, 5),
            (11, [float("inf"), 1.0], 1, 5), (12, [2.0, 0.0], 1, 5)]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cell int")
    out = e.near_duplicates(df).collect()
    assert len(out) == len(rows)
    by = {r["vec_id"]: r for r in out}
    assert by[1]["n_links"] == 3 and by[2]["n_links"] == 3 and by[12]["n_links"] == 3 and by[12]["component_id"] == 1
    assert all(by[i]["n_links"] == 0 and by[i]["kept"] for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, None))


def test_search_reaches_every_vector_in_range():
    v = e.unit_rows(clustered(400, 12, 3, 0.3))
    import pandas as pd
    graph = e.shard_graph(pd.DataFrame({"cell": "c", "id": np.arange(400), "vec": list(v)}))
    lists = [np.array(x, np.int64) for x in graph["neighbours"]]
    start = int(np.flatnonzero(graph["medoid"])[0])
    found = true = 0
    for k in range(400):
        want = set(np.flatnonzero(v @ v[k] >= 0.93).tolist())
        found += len(want & set(e.range_search(v, lists, start, v[k], 32, 0.93)))
        true += len(want)
    assert found >= 0.98 * true


def test_empty_table(llm):
    assert e.near_duplicates(llm.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def near_vectors(n, dims=16, spread=0.05, seed=5):
    """One dense group: nearly all of its pairs are links."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=dims)
    return [[float(x) for x in centre + spread * rng.normal(size=dims)] for _ in range(n)]


def test_dense_groups_lose_no_link(llm, monkeypatch):
    monkeypatch.setattr(e, "BLOCK", 150)  # several blocks a label
    rows = [(k, v, 1) for k, v in enumerate(near_vectors(900, spread=0.16))] + [(1000 + k, v, 2) for k, v in enumerate(clustered(200, 16, 8, 0.2))]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    links, component = brute_force(rows)
    assert 0.3 < sum(links[k] for k in range(900)) / (900 * 899) < 1
    got = {r["vec_id"]: r for r in e.near_duplicates(df, shard_size=200).collect()}
    assert all(got[k]["n_links"] == links[k] and got[k]["component_id"] == component[k] for k in range(900))
    assert sum(got[k]["n_links"] for k in range(1000, 1200)) >= 0.95 * sum(links[k] for k in range(1000, 1200))


def test_labels_that_fail_the_audit_are_compared_in_blocks(llm, monkeypatch):
    monkeypatch.setattr(e, "DENSE_SHARE", 2.0)  # no label counts as dense
    monkeypatch.setattr(e, "range_search", lambda *a: [])  # and the graph finds nothing
    rows = [(k, v, 1) for k, v in enumerate(clustered(150, 12, 2, 0.2))] + [(500, [1.0] * 12, 2)]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(e, "audit", lambda classes, *a: ["1:12"])
    links, component = brute_force(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in e.near_duplicates(df).collect()} == {k: (links[k], component[k]) for k in links}


def test_audit_names_the_labels_that_lost_links(llm):
    rows = [(f"{k % 2}:8", k, 1, v) for k, v in enumerate(near_vectors(120, 8))]
    classes = llm.createDataFrame(rows, "cell string, id long, w long, vec array<double>")
    full = classes.select("id").selectExpr("id", "59L AS n")
    assert e.audit(classes, full, 0.93, 0.95) == []
    assert e.audit(classes, full.selectExpr("id", "IF(id = 4, 40L, n) AS n"), 0.93, 0.95) == ["0:8"]  # one query
    assert e.audit(classes, full.where("id % 2 = 0"), 0.93, 0.95) == ["1:8"]


def test_cells_that_no_centre_tells_apart(llm, monkeypatch):
    monkeypatch.setattr(e, "DENSE_SHARE", 2.0)
    monkeypatch.setattr(e, "MAX_LEVEL", 0)
    rows = [(k, v, 1) for k, v in enumerate(clustered(260, 12, 3, 0.2))]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    links, component = brute_force(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in e.near_duplicates(df, shard_size=20).collect()} == {k: (links[k], component[k]) for k in links}
