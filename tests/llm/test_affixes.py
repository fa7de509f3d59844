"""Words around values are learned from the values; all entries within the distance come out."""

from lectern.llm import canonical

REF = "type_id long, type_name string, aliases array<string>, value string"
NAMES = ["harbour", "lighthouse", "bridge keeper", "salt trade", "weaving", "tide table", "old market", "river ferry", "stone quarry", "horn signal", "rope walk", "grain store"]


def reference(spark, names=NAMES):
    return spark.createDataFrame([(i + 1, n, None, "x") for i, n in enumerate(names)], REF)


def matched(spark, values, ref=None):
    df = canonical.match_values(spark.createDataFrame([(v,) for v in values], "value string"), "value", reference(spark) if ref is None else ref, "type_id", "type_name", "aliases")
    return {r["value"]: r["entry_id"] for r in df.collect()}


def test_unseen_wrappers_are_learned(spark):
    values = [f"zu {n}" for n in NAMES] + [f"{n} gruppe 7" for n in NAMES] + [f"feld~{n}~ende" for n in NAMES]
    got = matched(spark, [*values, "zu lihgthouse", "salt tarde gruppe 12", "quite other words", "zu nothing known"])
    assert {v: got[v] for v in values} == {v: i % len(NAMES) + 1 for i, v in enumerate(values)}
    assert (got["zu lihgthouse"], got["salt tarde gruppe 12"]) == (2, 4)
    assert got["quite other words"] == got["zu nothing known"] == 0


def test_parts_of_entries_are_no_affixes(spark):
    names = spark.createDataFrame([(0, 1, "person place"), (1, 2, "place"), (2, 3, "person")], "n long, i long, s string")
    values = spark.createDataFrame([(v,) for v in ("person place", "persn place", "place person", "person plcae")], "value string")
    assert canonical.learn_affixes(values, names) == frozenset()


def test_a_word_that_mostly_stands_elsewhere_is_none(spark):
    names = spark.createDataFrame([(0, 1, "harbour")], "n long, i long, s string")
    values = spark.createDataFrame([("new harbour",), *((f"new {x}",) for x in ("taxes", "bus", "pizza", "server", "kitten"))], "value string")
    assert canonical.learn_affixes(values, names) == frozenset()


def test_all_entries_within_the_distance(spark):
    ref = reference(spark, ["parable", "parables", "arable", "harvest"])
    df = canonical.all_matches(spark.createDataFrame([("parabel",), ("harvest",), (None,), ("zzz",)], "value string"), "value", ref, "type_id", "type_name", "aliases")
    rows = {(r["value"], r["entry_id"]): r["rank"] for r in df.collect()}
    assert {k for k in rows if k[0] == "parabel"} == {("parabel", 1), ("parabel", 2), ("parabel", 3)}
    assert rows["parabel", 1] == 1
    assert rows["harvest", 4] == 1
    assert not [k for k in rows if k[0] in (None, "zzz")]


def test_parts_of_the_reference_are_numbered_once(spark, monkeypatch):
    values = ["harbour", "zu harbour", "zu weaving", "tied table"]
    whole = matched(spark, values)
    monkeypatch.setattr(canonical, "TRIE_ENTRIES", 5)
    assert matched(spark, values) == whole
    assert canonical.all_matches(spark.createDataFrame([("x",)], "value string"), "value", reference(spark).limit(0), "type_id", "type_name", "aliases").count() == 0
