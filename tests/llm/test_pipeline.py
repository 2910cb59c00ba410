"""The corpus pipeline, each stage against a plain version of what it decides."""

import corpus_pipeline as cp
from tessera.llm import mixing, repetition
from tessera.llm.common import Workspace
from tests.llm.test_operators import ALNUM, LOW, brute_components


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    stage = dict(cp.STAGES)
    one = stage["quality_rules"](spark, docs, sf)
    assert set(texts(one)) == {i for i, t in texts(docs).items() if repetition.measure((t or "").encode(), repetition.Rules())[6]}
    one = one.cache()
    two = stage["near_duplicates"](spark, one, sf).cache()
    comp = brute_components(list(texts(one).items()), 5, 80)
    assert set(texts(two)) == {i for i, (_, c) in comp.items() if c == i}
    three = stage["decontamination"](spark, two, sf).cache()
    grams = lambda t, n: {tuple(w[i : i + n]) for w in [ALNUM.findall((t or "").translate(LOW))] for i in range(len(w) - n + 1)}
    bench = set().union(*(grams(r.text, 10) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()))
    assert set(texts(three)) == {i for i, t in texts(two).items() if not grams(t, 10) & bench}
    four = stage["mix_domains"](spark, three, sf).cache()
    rates = {r.doc_id: r.copies for r in mixing.mix(three, mixing.domains_of(spark.read.parquet(f"{sf}/labels.parquet")), most=1.0).collect()}
    assert set(texts(four)) == {i for i in texts(three) if rates[i]}
    five = stage["sharding"](spark, four, sf)
    assert five.columns == [*cp.COLUMNS, "shard"] and five.count() == four.count()
    assert all(df.columns == cp.COLUMNS for df in (one, two, three, four))


def test_run(spark):
    import os

    before = len(Workspace.opened)
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0
    # nothing is left of the stages but the last one's table
    assert len(Workspace.opened) == before + 1 and [x.split("-", 1)[1] for x in os.listdir(Workspace.opened[-1].top)] == ["sharding"]


def test_registered():
    import __spark_entry__ as e

    assert e.queries()["pipeline"] is cp.run
    assert {n.split("_")[0] for n in e.queries() if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert set(e.oracle_sql()) <= set(e.queries())


def test_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns with clashing names, and no rows, through each stage."""
    sf, stage = "/root/testdata/sf0.001", dict(cp.STAGES)
    long = " ".join(f"w{i * 7919 % 50021}" for i in range(40_000))
    docs = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, long, None, None, None), (3, long, "en", "s", 1), (4, "a b c", None, "s", 2), (4, "a b c", None, "s", 2), (5, " \n", "en", None, 2)]
    df = spark.createDataFrame([(*d, 1, 2, 3, "x") for d in docs], "doc_id long, text string, lang string, source string, n_chars long, _number int, slot int, shard int, key string")
    for name, size in (("quality_rules", 2), ("near_duplicates", 5), ("decontamination", 7)):
        out = stage[name](spark, df, sf)
        assert out.columns == cp.COLUMNS and out.count() == size, name
    assert [r.doc_id for r in stage["near_duplicates"](spark, df, sf).where("length(text) > 10").collect()] == [3]
    mixed = stage["mix_domains"](spark, df, sf)
    assert mixed.columns == cp.COLUMNS and mixed.count() <= 7
    last = stage["sharding"](spark, df, sf)
    assert last.count() == 7 and last.where("shard IS NULL").count() == 0 and set(df.columns) - {"slot"} == set(last.columns)
    for name, work in cp.STAGES:
        assert work(spark, df.select(*cp.COLUMNS).where("false"), sf).count() == 0, name


def test_null_and_repeated_ids(spark, monkeypatch):
    """Each stage decides on rows: those without an id, and those that share one, are as any other."""
    sf, stage = "/root/testdata/sf0.001", dict(cp.STAGES)
    leak = max((r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()), key=lambda t: len((t or "").split()))
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    docs = [(None, text(1)), (None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (8, text(5)), (None, text(5)), (9, text(6)), (9, text(7) + " " + leak), (None, text(8) + " " + leak)]
    df = spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    rows = lambda x: sorted(((r.doc_id, r.text) for r in x.collect()), key=repr)
    one = stage["quality_rules"](spark, df, sf)
    assert rows(one) == sorted(docs, key=repr)
    two = stage["near_duplicates"](spark, one, sf)
    assert rows(two) == sorted([docs[k] for k in (0, 2, 3, 4, 5, 7, 8, 9)], key=repr)
    three = stage["decontamination"](spark, two, sf)
    assert rows(three) == sorted([docs[k] for k in (0, 2, 3, 4, 5, 7)], key=repr)
    monkeypatch.setattr(mixing, "fit", lambda *a: ([], 0.0))  # rates of 1: all stay
    four = stage["mix_domains"](spark, three, sf)
    assert rows(four) == rows(three)
    five = stage["sharding"](spark, four, sf)
    assert rows(five) == rows(four) and five.where("shard IS NULL").count() == 0
