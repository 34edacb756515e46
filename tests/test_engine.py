"""Blocking, search, matching, groups, store, service, streaming and command line on small data."""

import io
import json
import os
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from entwine import cli, config
from entwine.functions.normalize import normalize_entity
from entwine.operators import blocking as B
from entwine.operators import groups as G
from entwine.operators import matching as M
from entwine.operators import vector_groups
from entwine.operators.search import similar, similar_pairs, top_k, top_k_in_block
from entwine.operators.vector_groups import VectorEdges
from entwine.plans import queries
from entwine.plans.shared import scratch, staged
from entwine.service import Linker
from entwine.sources.embedder import cached, embed_texts
from entwine.sources.json_io import read_entities
from entwine.sources.store import Conflict, EntityStore
from entwine.streaming.ingest import stream_entities, windowed_counts

SAMPLE = [
    ("entity-001", "Acme Corporation", "123 Main Street", "New York", "NY", "10001", "+1 (555) 123-4567", "info@acme.com"),
    ("entity-002", "Acme Corp.", "123 Main St", "New York", "New York", "10001", "555-123-4567", "contact@acme.com"),
    ("entity-003", "Globex Corporation", "456 Park Avenue", "Boston", "MA", "02108", "+1 (555) 987-6543", "info@globex.com"),
]
FLAT = "id string, name string, address string, city string, state string, zip string, phone string, email string"


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame(SAMPLE, FLAT)


def test_blocking_keys(spark, sample):
    got = dict(B.assign_blocks(normalize_entity(sample)).select("id", "cluster_id").collect())
    assert got == {"entity-001": "695a91c1159e6ff2", "entity-002": "695a91c1159e6ff2", "entity-003": "88da7fc7eb268381"}
    blank = spark.createDataFrame([("x", "", None)], "id string, name string, zip string")
    assert B.assign_blocks(blank).first()["cluster_id"] == "default"
    assert B.assign_blocks(blank, enabled=False).first()["cluster_id"] == "default"
    more = spark.createDataFrame([("x", "é1", "12", "a@b@c", "12")], "id string, name string, zip string, email string, phone string")
    assert len(B.assign_blocks(more, ["name", "zip", "email", "phone"]).first()["cluster_id"]) == 16
    pairs = B.candidate_pairs(B.assign_blocks(normalize_entity(sample)), ["name"]).collect()
    assert [(p["id_a"], p["id_b"]) for p in pairs] == [("entity-001", "entity-002")]


def test_top_k(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 1.0], "a"), (3, [0.0, 1.0], "b"), (4, None, "a"), (5, [0.0, 0.0], "a"), (6, [2.0, 0.0], "b")], "id long, vector array<double>, cluster_id string")
    asked = rows.filter("id = 1").withColumnRenamed("id", "query_id")
    assert [(r["id"], round(r["score"], 6)) for r in top_k(asked, rows, 3).orderBy("rank").collect()] == [(1, 1.0), (6, 1.0), (2, 0.707107)]
    assert [r["id"] for r in top_k_in_block(asked, rows, 9, "cluster_id").orderBy("rank").collect()] == [1, 2, 5]
    assert top_k(asked.limit(0), rows, 3).count() == 0 and top_k(asked, rows.limit(0), 3).count() == 0


def test_no_cross_join_and_no_row_udf(spark, sample):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = B.assign_blocks(normalize_entity(sample))
    assert "Cartesian" not in plan(B.candidate_pairs(rows, ["name"])) and "NestedLoop" not in plan(B.candidate_pairs(rows, ["name"]))
    assert "Python" not in plan(rows)


@pytest.mark.parametrize("text, want", [("name=Acme", {"name": "Acme"}), ("name=Acme;city=NY", {"name": "Acme", "city": "NY"}), ("name=Acme,address=123 St", {"name": "Acme", "address": "123 St"}), ("noequals", {}), ("a=1;b=2;c=3", {"a": "1", "b": "2", "c": "3"}), (" a = 1 ; =x; b=; a=2=3 ", {"a": "2=3"}), (None, {})])
def test_parse_query_fields(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(M.parse_query_fields("t")).first()[0] == want


def test_weighted_score_and_explanation(spark):
    df = spark.createDataFrame([(0.8, 0.5, None)], "a double, b double, c double")
    cols = {k: F.col(k) for k in "abc"}
    assert df.select(M.weighted_score({"name": cols["a"], "phone": cols["b"]}, {"name": 0.6, "phone": 0.4})).first()[0] == pytest.approx(0.68)
    assert df.select(M.weighted_score({"c": cols["c"]}, {})).first()[0] == 0.0
    assert df.select(M.blended_score(F.lit(0.5), {"c": cols["c"]}, {"c": 1.0})).first()[0] == 0.5
    assert df.select(M.explanation(F.col("a"), F.array(F.lit("city"), F.lit("name")))).first()[0] == "Matched with medium confidence (0.80) on fields: city, name"


def test_flatten_gives_stable_ids(spark):
    df = spark.createDataFrame([("", {"name": "A", "x": "y"}, None), (None, {"name": "A", "x": "y"}, None), ("k", {}, {"m": "1"})], "id string, fields map<string,string>, metadata map<string,string>")
    rows = M.flatten(df).collect()
    assert rows[0]["id"] == rows[1]["id"] and len(rows[0]["id"]) == 64 and rows[2]["name"] == "" and rows[0]["name"] == "A"


def edges_of(spark, pairs):
    return G.symmetric(spark.createDataFrame(pairs, "a string, b string, score double"))


def test_groups(spark):
    edges = edges_of(spark, [("a", "b", 0.95), ("b", "c", 0.9), ("c", "d", 0.86), ("d", "e", 0.99), ("a", "f", 0.87), ("x", "y", 0.99)])
    seed = spark.createDataFrame([("a",)], "id string")
    get = lambda **o: {r["id"]: (round(r["score"], 2), r["hop_distance"]) for r in G.match_groups(seed, edges, G.GroupOptions(**o)).collect()}
    assert get(strategy="direct") == {"a": (1.0, 0), "b": (0.95, 1), "f": (0.87, 1)}
    assert get(strategy="transitive", hops=2) == {"a": (1.0, 0), "b": (0.95, 1), "f": (0.87, 1), "c": (0.9, 2)}
    assert get(strategy="hybrid", hops=3) == {"a": (1.0, 0), "b": (0.95, 1), "c": (0.9, 2), "d": (0.86, 3), "f": (0.87, 3)}  # f by way of b and a
    assert get(strategy="transitive", hops=9, max_size=2) == {"a": (1.0, 0), "b": (0.95, 1)}
    with pytest.raises(ValueError):
        get(strategy="other")
    parts = dict(G.components(edges_of(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("x", "y", 1.0)]).select(F.col("src").alias("a"), F.col("dst").alias("b"))).collect())
    assert parts == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_groups_of_vectors_as_by_joins(spark, monkeypatch):
    """Bits for each row and group give the members that joins give; a few groups and rows at a time give the same."""
    rng = np.random.RandomState(5)
    x = rng.normal(size=(240, 8))
    x[7], x[8], x[9] = x[3], 0, x[3] * 2
    rows = spark.createDataFrame([(f"v{k:03d}", v.tolist()) for k, v in enumerate(x)] + [("none", None), ("gap", [None] + [1.0] * 7)], "id string, vector array<double>")
    seeds = spark.createDataFrame([(f"v{k:03d}",) for k in (*range(0, 240, 3), 8, 8)] + [("none",), ("gap",), ("unknown",)], "id string")
    edges = VectorEdges(rows, 0.5)
    get = lambda e, **o: sorted((r["group_id"], r["id"], round(r["score"], 9), r["hop_distance"]) for r in G.match_groups(seeds, e, G.GroupOptions(0.55, None, direct_floor=0.7, **o)).collect())
    options = [{"strategy": "direct"}, {"strategy": "transitive", "hops": 0}, {"strategy": "transitive", "hops": 2}, {"strategy": "transitive", "hops": 4}, {"strategy": "hybrid", "hops": 3}]
    want = [get(lambda ids: edges(ids), **o) for o in options]
    assert len(want[1]) == 84 and max(r[3] for r in want[3]) > 2
    monkeypatch.setattr(G, "staged", None)
    assert [get(edges, **o) for o in options] == want
    monkeypatch.setattr(vector_groups, "BIT_BYTES", 1)
    monkeypatch.setattr(vector_groups, "CELLS", 5000)
    assert [get(edges, **o) for o in options[3:]] == want[3:]
    monkeypatch.undo()
    twice = VectorEdges(rows.unionByName(rows.limit(3)), 0.5)
    assert get(twice, **options[2]) == want[2]


@pytest.mark.parametrize("name", ["group_stats", "group_hybrid", "group_transitive"])
def test_group_queries_write_no_paths(spark, monkeypatch, name):
    def written(df, tag):
        raise AssertionError(f"{tag} is written")

    monkeypatch.setattr(G, "staged", written)
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count()


def test_group_agreement(spark, sample):
    members = spark.createDataFrame([("g", "entity-001", 1.0), ("g", "entity-002", 0.9)], "group_id string, id string, score double")
    stats = G.group_stats(members).first()
    assert (stats["size"], round(stats["score"], 3)) == (2, 0.95)
    got = {r["field"]: r for r in G.field_agreement(members, sample, ["city", "state", "name"]).collect()}
    assert (got["city"]["value"], got["city"]["agreement"], round(got["city"]["confidence"], 3)) == ("New York", 1.0, 0.95)
    assert got["state"]["value"] == "NY" and got["state"]["agreement"] == 0.5  # a tie goes to the smaller value
    assert G.golden_record(members, sample, ["city", "name"]).first()["name"] == "Acme Corp."


@pytest.fixture
def linker(spark, tmp_path):
    c = config.Config()
    c.store.path, c.embedding.embedding_dim, c.clustering.enabled = f"file://{tmp_path}/store", 16, True
    return Linker(spark, c)


def test_service(spark, sample, linker):
    assert linker.health() and linker.count() == 0
    linker.add_entities(sample)
    assert linker.count() == 3 and linker.get_entity("entity-002").first()["name_normalized"] == "acme"
    asked = spark.createDataFrame([("q", "Acme Corp", "123 Main Street", "New York", "NY", "10001")], "id string, name string, address string, city string, state string, zip string")
    got = linker.match_entities(asked, M.MatchOptions(limit=5, threshold=0.1, field_weights={"name": 1.0})).orderBy("rank").collect()
    assert {r["id"] for r in got} == {"entity-001", "entity-002"} and got[0]["score_name"] == 1.0
    assert linker.match_text("name=Acme Corp;zip=10001", M.MatchOptions(threshold=0.0)).count() == 2
    linker.update_entities(spark.createDataFrame([("entity-003", "Initech")], "id string, name string"))
    assert linker.get_entity("entity-003").first()["name"] == "Initech" and linker.get_entity("entity-003").first()["zip"] == "02108"
    linker.recompute_clusters()
    seeds = spark.createDataFrame([("entity-001",)], "id string")
    group = json.loads(linker.group_json(seeds, G.GroupOptions(threshold=0.1, strategy="direct")).first()["json"])
    assert group["size"] == 2 and group["primary_id"] == "entity-001" and group["sample_fields"]["zip"]["agreement"] == 1.0
    linker.delete_entities(seeds)
    assert [r["id"] for r in linker.list_entities(0, 1).collect()] == ["entity-002"]
    with pytest.raises(ValueError):
        linker.add_entities(spark.createDataFrame([("z", [1.0])], "id string, vector array<float>"), raw=True)


def test_cli(spark, linker, tmp_path):
    fields = FLAT.replace(" string", "").split(", ")
    data = [{"id": r[0], "fields": dict(zip(fields[1:], r[1:])), "metadata": {"source": "CRM"}} for r in SAMPLE]
    (tmp_path / "in.json").write_text(json.dumps(data, indent=1))
    (tmp_path / "q.json").write_text(json.dumps({"fields": {"name": "Acme Corp", "zip": "10001"}}, indent=1))
    assert read_entities(spark, f"file://{tmp_path}/in.json").count() == 3
    with redirect_stdout(io.StringIO()) as out:
        cli.main(["--ingest", f"file://{tmp_path}/in.json", "--match-file", f"file://{tmp_path}/q.json", "--threshold", "0.1", "--group", "entity-001", "--field-scores"], spark, linker)
    assert "ingested 3 entities" in out.getvalue() and "entity-002" in out.getvalue() and '"primary_id":"entity-001"' in out.getvalue()


def test_streaming(spark, sample, linker, tmp_path):
    sample.limit(2).write.json(f"{tmp_path}/in/1")
    stream = spark.readStream.schema(FLAT).json(f"{tmp_path}/in/*")
    for _ in range(2):
        stream_entities(stream, linker, f"{tmp_path}/ckpt", f"{tmp_path}/matches", trigger={"availableNow": True}).awaitTermination()
        sample.filter("id <> 'entity-001'").write.mode("ignore").json(f"{tmp_path}/in/2")
    assert linker.count() == 3
    (tmp_path / "events").mkdir()
    events = spark.readStream.schema("t timestamp, k string").json(f"{tmp_path}/events")
    assert windowed_counts(events, "t", "k").isStreaming


def test_embedder_asks_once_for_each_text(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, ""), (4, None)], "id int, text string")
    got = {r["id"]: r["vector"] for r in embed_texts(df, lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], 2).collect()}
    assert got == {1: [2.0, 1.0], 2: [2.0, 1.0], 3: [0.0, 0.0], 4: [0.0, 0.0]}


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("ENTWINE_MATCHING_DEFAULT_LIMIT", "7")
    path = tmp_path / "c.json"
    config.save_default(str(path))
    path.write_text(path.read_text().replace('"default_limit": 10', '"default_limit": 3').replace('"enabled": false', '"enabled": true'))
    c = config.load(str(path))
    assert c.matching.default_limit == 7 and c.clustering.enabled and config.load("missing.yaml").matching.similarity_threshold == 0.85


def test_store_versions(spark, tmp_path):
    """No update is lost: appends add to what others wrote, other changes refuse to overwrite it."""
    a, b = (EntityStore(spark, f"file://{tmp_path}/s", buckets=4) for _ in range(2))
    a.create()
    rows = lambda *ids: spark.createDataFrame([(i, f"n{i}") for i in ids], "id string, name string")
    a.add(rows("1", "2"))
    number, state = b._state()
    a.add(rows("3"))
    with pytest.raises(Conflict):
        b._point(number, state)
    b.add(rows("4"))
    assert {r["id"] for r in a.read().collect()} == {"1", "2", "3", "4"} and b.count() == 4
    twice = spark.createDataFrame([("1", "x"), ("1", "y"), ("9", "z")], "id string, name string")
    a.update(twice)
    assert {r["id"]: r["name"] for r in a.read().collect()} == {"1": "y", "2": "n2", "3": "n3", "4": "n4"}
    before = a._state()[1]["parts"]
    a.upsert(spark.createDataFrame([("2", "new"), ("5", "n5"), ("", "blank"), (None, "blank")], "id string, name string"))
    got = {r["id"]: r["name"] for r in a.read().collect()}
    assert got.pop("2") == "new" and sorted(got.values()) == ["blank", "n3", "n4", "n5", "y"]
    touched = a._touched(a._state()[1], spark.createDataFrame([(i,) for i in got if len(i) == 64] + [("2",), ("5",)], "id string"))
    assert all(ps == before[x] for x, ps in a._state()[1]["parts"].items() if x not in touched)
    assert a.get("3").first()["name"] == "n3" and len(a.get("3").inputFiles()) <= 2 and a.get("none").count() == 0
    for k in range(10, 20):
        a.add(rows(str(k)))
    a.compact()
    assert max(map(len, a._state()[1]["parts"].values())) <= 8 and a.count() == 16
    a.delete(rows(*map(str, range(20))))
    assert {r["name"] for r in a.read().collect()} == {"blank"}


def test_similar_pairs(spark):
    rng = np.random.RandomState(1)
    x = rng.normal(size=(60, 4))
    rows = spark.createDataFrame([(f"k{i:02d}", v.tolist()) for i, v in enumerate(x)] + [("n", None), ("o", [1.0]), ("p", [1.0, None, 0.0, 0.0])], "id string, vector array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(f"k{i:02d}", f"k{j:02d}") for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.6, 1)))}
    for block in (7, 1000):
        assert {(r["a"], r["b"]) for r in similar_pairs(rows, 0.6, block_rows=block).collect()} == want
    asked = rows.filter("id < 'k05'").withColumnRenamed("id", "query_id")
    got = {(r["query_id"], r["id"]) for r in similar(asked, rows, 0.6).collect()}
    assert got == {(a, b) for a, b in want | {(b, a) for a, b in want} | {(f"k{i:02d}", f"k{i:02d}") for i in range(5)} if a < "k05"}


def test_scratch(spark, tmp_path):
    with scratch():
        path = staged(spark.range(3), "x").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_embedding_cache():
    asked = []
    ask = cached(lambda texts: asked.append(texts) or [[float(len(t))] for t in texts], "model", 2)
    assert ask(["a", "bb", "a", "ccc"]) == [[1.0], [2.0], [1.0], [3.0]] and ask(["bb", "ccc"]) == [[2.0], [3.0]]
    assert asked == [["a", "bb", "ccc"], ["ccc"]]
