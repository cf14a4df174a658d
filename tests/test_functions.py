"""Hand-checked values of text functions, ranking, taxonomy and evaluation."""

import difflib
import math

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import evaluate as E
from lodestrata.operators import fts, graph, pairs, rank, temporal
from lodestrata.operators import taxonomy as H


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("word,stem", [("catalysts", "catalyst"), ("adsorption", "adsorp"), ("metals", "metal"), ("gas", "gas"), ("glass", "glass"), ("coupling", "coupl")])
def test_stem(spark, word, stem):
    assert one(spark, T.stem(F.col("w")), w=word) == stem == T.stem_word(word)


def test_fold(spark):
    assert one(spark, T.fold(F.col("t")), t="H₂O – 25 °C ﬁt") == "H2O - 25  C fit"
    assert T.fold_text("CO₂") == "CO2"


def test_clean_words(spark):
    assert one(spark, T.clean_words(F.col("t")), t='What is the "Suzuki" coupling?') == ["Suzuki", "coupling"]
    assert one(spark, T.clean_words(F.col("t")), t="what is this") == ["what", "is", "this"]
    assert T.clean_query("the of") == ["the", "of"]


def test_sentences_keep_digits_and_lose_spaces(spark):
    text = "0 nought. 1st one! \n \u00a02nd? 3.5 mg \n\n  4191 b.\x0bc "
    assert one(spark, T.sentences(F.col("t")), t=text) == ["0 nought.", "1st one!", "2nd?", "3.5 mg", "4191 b.\x0bc"]


@pytest.mark.parametrize("value,key", [("Suzuki Coupling Reactions", "suzuki_coupling"), ("CO2 reduction", "carbon_dioxide_reduction")])
def test_concept_key(spark, value, key):
    assert one(spark, T.concept_key(F.col("v"), {"co2": "carbon_dioxide"}), v=value) == key


def test_soft_and_scoped_keys(spark):
    assert one(spark, T.soft_key(F.col("v")), v="polymerisation studies") == "polymerization_study"
    assert one(spark, T.scoped_key(F.array(F.lit("electrode_materials"), F.lit("metals_and_metal_alloys")))) == "metal_alloy"


def test_titles_and_numbers(spark):
    assert one(spark, T.display_title(F.col("v")), v="ml_for_drug_discovery") == "ML for Drug Discovery"
    assert [one(spark, T.loose_number(F.col("v")), v=x) for x in ("95%", " 12.5 ", "n/a")] == [95.0, 12.5, None]
    assert one(spark, T.author_list(F.col("v")), v='["A  B","A B"]') == ["A B"]
    assert one(spark, T.author_list(F.col("v")), v="Solo Name") == ["Solo Name"]


def test_sequence_ratio(spark):
    rows = [("hot ring", "hot rod"), ("", "x"), ("same", "same")]
    got = [r["x"] for r in spark.createDataFrame(rows, "a string, b string").coalesce(1).select(T.sequence_ratio(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == pytest.approx([difflib.SequenceMatcher(None, a, b).ratio() for a, b in rows])


def test_author_hint_and_variants():
    assert T.author_hint("papers by Ada Lovelace") == "Ada Lovelace"
    assert T.author_hint("metal fatigue") == ""
    v = T.query_variants("metal alloys", {"metal alloys": ["intermetallics"]}, {"alloys": ["steel"]})
    assert v[0] == "metal alloys" and "intermetallics" in v and "metal steel" in v and "metal alloy" in v


def test_compile_query():
    kinds = [c.kind for c in fts.compile_query("suzuki coupling reactions")]
    assert kinds[:3] == ["phrase", "near", "all"]
    assert [c.kind for c in fts.compile_query("suzuki")] == ["all", "prefix"]
    assert fts.compile_query("a b", "any")[0].kind == "any"


def test_rrf(spark):
    lists = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (1, "b", 1)], "list_no int, id string, rank int")
    got = {r["id"]: r["score"] for r in rank.fuse(lists).collect()}
    assert got == pytest.approx({"a": 1 / 61, "b": 1 / 62 + 1 / 61}, abs=1e-6)


def test_ndcg(spark):
    run = spark.createDataFrame([("p", "x", 1), ("p", "y", 2)], "probe string, id string, rank int")
    j = spark.createDataFrame([("p", "y", 1.0)], "probe string, id string, gain double")
    assert E.ndcg(run, j, 2).first()["ndcg"] == pytest.approx(1 / math.log2(3), abs=1e-6)
    none = spark.createDataFrame([("p", "y", 0.0)], "probe string, id string, gain double")
    assert E.ndcg(run, none, 2).first()["ndcg"] is None


def test_bootstrap_is_reproducible(spark):
    p = spark.createDataFrame([(str(i), float(i % 3)) for i in range(30)], "probe string, d double")
    a, b = E.bootstrap(p, "d", 300, 5).first(), E.bootstrap(p, "d", 300, 5).first()
    assert a == b and a["low"] <= 1.0 <= a["high"]


@pytest.mark.parametrize("counts,surge,decline", [([2, 5], True, False), ([6, 2], False, True), ([5, 2], False, False)])
def test_surge(spark, counts, surge, decline):
    df = spark.createDataFrame(list(enumerate(counts)), "y int, n int")
    last = temporal.surge_decline(df, "y", "n").orderBy("y").collect()[-1]
    assert (last["surge"], last["decline"]) == (surge, decline)


def test_positions(spark):
    f = lambda i, n: one(spark, graph.position(F.lit(i), F.lit(n)))
    assert [f(1, 1), f(1, 3), f(2, 3), f(3, 3), one(spark, graph.position(F.lit(None).cast("int"), F.lit(3)))] == ["first", "first", "middle", "last", "unknown"]


def test_node_match(spark):
    nodes = spark.createDataFrame([("cross_coupling/suzuki_miyaura",), ("condensed_matter/spin_coupling",)], "path string")
    got = [r["path"] for r in H.node_matches(nodes, ["suzuki", "coupl"], ["coupl"]).collect()]
    assert got == ["cross_coupling/suzuki_miyaura"]


def test_alias_cycle(spark):
    with pytest.raises(ValueError):
        H.alias_closure(spark.createDataFrame([("a", "b"), ("b", "a")], "old string, new string"))


def test_cues(spark):
    assert one(spark, pairs.cue_conflict(F.col("a"), F.col("b")), a="a high yield", b="LOW yield") == 1
    assert one(spark, pairs.cue_conflict(F.col("a"), F.col("b")), a="yield", b="low") == 0


def test_greedy_match(spark):
    rows = [("d", 1, 10, 0.9), ("d", 1, 11, 0.8), ("d", 2, 10, 0.85), ("d", 2, 11, 0.6)]
    got = pairs.greedy_match(spark.createDataFrame(rows, "doc string, gold long, found long, score double"), "doc").collect()
    assert {(r["gold"], r["found"]) for r in got} == {(1, 10), (2, 11)}


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (3, 9)], "a long, b long")
    assert {(r["node"], r["root"]) for r in graph.components(links).collect()} == {(1, 1), (2, 1), (3, 1), (9, 1), (5, 5), (6, 5)}


def test_greedy_match_takes_the_whole_table(spark, tmp_path):
    from lodestrata.plans import registry

    rows = [(i, f"name{i // 2}", "ECONOMY", i % 2) for i in (10, 11, 300, 301, 20_000, 20_001)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = registry.queries()["greedy_match"](spark, str(tmp_path)).collect()
    assert {(r["gold"], r["found"]) for r in got if r["score"] == 1.0} == {(10, 11), (300, 301), (20_000, 20_001)}
