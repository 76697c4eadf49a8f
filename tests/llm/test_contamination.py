"""Decontamination against brute force, and slot consistency by example."""

import regex

from labelloom.llm import contamination, queries


def words(text):
    """Template words as the module describes them, in plain Python."""
    t = regex.sub("[#@~]", " ", text or "")
    t = regex.sub(r"\p{Lu}(?<=[\p{Ll}\p{N},;:][ \t\r\n].)\p{Ll}+", " @ ", t)
    t = regex.sub(rf"[0-9]+ ?(?i:{contamination.UNITS})(?![\p{{L}}\p{{N}}])", " # ~ ", t)
    t = regex.sub("[0-9]+", " # ", t)
    return [w for w in regex.split(r"[^\p{L}\p{M}#@~0-9]+", t.lower()) if w]


def windows(text, k=8):
    w = words(text)
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def test_query_finds_what_brute_force_finds(spark, sf_dir):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = set()
    own = {i: windows(t) for i, t in items.items()}
    assert not any(set("#@~") & set(w) for ws in own.values() for w in ws)
    for d, text in docs.items():
        seen = set(windows(text))
        for i, ws in own.items():
            hits = sum(w in seen for w in ws)
            if ws and hits >= 0.5 * len(ws):
                want.add((d, i, hits, len(ws)))
    got = {(r.doc_id, r.item_id, r.windows, r.usable) for r in queries.QUERIES["op10_contamination"](spark, sf_dir).collect()}
    assert got == want and any(items[i] in docs[d] for d, i, _, _ in want)


ITEM = ("A train leaves London at 9 with 120 passengers and covers 300 km in 5 hours before it stops near the old "
        "river bridge in Oxford again at 9")


def test_slots_must_map_one_to_one(spark):
    changed = ITEM.replace("London", "Paris").replace("9", "7").replace("120", "250").replace("300", "400").replace("5 ", "8 ").replace(
        "Oxford", "Lyon")
    torn = changed[: changed.rindex("7")] + "8"  # one 9 became 7, the other 8
    docs = [(1, "Intro text. " + changed + " and more."), (2, torn), (3, "nothing here"), (4, None), (5, ""), (None, ITEM), (1, ITEM.upper()),
            (7, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19")]
    bench = [(10, ITEM), (11, ITEM), (12, "too short"), (13, None), (14, "1 2 3 4 5 6 7 8 9 10 11 12")]
    found = contamination.find(
        spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, usable int"),
        spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.changed) for r in found} == {(1, 10, True), (1, 11, True), (None, 10, False), (None, 11, False)}


def test_clean_rows_stay_whole(spark):
    docs = spark.createDataFrame([(1, ITEM, "x"), (2, "clean words", "y"), (None, "also clean", "z"), (2, "clean words", "y")],
                                 "doc_id long, text string, hash string")
    bench = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    kept = contamination.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(
        [(2, "clean words", "y"), (None, "also clean", "z"), (2, "clean words", "y")], key=str)
    assert contamination.find(docs.limit(0), bench).collect() == []
    assert contamination.keep_clean(docs, bench.limit(0)).count() == 4


def test_a_large_benchmark_is_not_broadcast(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    assert len(contamination.find(docs, bench, broadcast_rows=0).collect()) == 1


DENSE = "In 1912 Anna sold 3 kg for 20 eur and 5 kg for 30 eur to Karl, Otto and 12 men of Bonn at 7 h"
LONG = ("the heavy stone wall along the northern edge of that field was built by hand during one long winter and it has "
        "kept every sheep of the farm safe since then although nobody has ever mended a single part of it in all those years")


def pairs(spark, docs, items):
    found = contamination.find(spark.createDataFrame(docs, "doc_id long, text string"),
                               spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id): r.changed for r in found.collect()}


def test_copies_word_for_word_are_found_whatever_they_hold(spark):
    part = " ".join(LONG.split()[10:24])
    docs = [(1, f"so it says: {DENSE}, they say"), (2, "well, Who wrote the old Song? nobody knows"), (3, f"once {part} but not here"),
            (4, " ".join(part.split()[:12]) + " but"), (5, "who wrote the song"), (6, "1 2 3 4 5 6 7 8 9")]
    items = [(20, DENSE), (21, "Who wrote the old song?"), (22, LONG), (23, "3 4 5"), (24, "")]
    assert pairs(spark, docs, items) == {(1, 20): False, (2, 21): False, (3, 22): False}


NAMED = ("Mary bakes fresh bread for the village. Mary also sells warm milk there. Mary never rests before noon. "
         "Mary walks home slowly. So Mary sleeps well")


def test_names_do_not_depend_on_case_or_place(spark):
    cities = "we went from London over Paris and from there to Berlin and past Madrid before we saw Rome at last"
    docs = [(1, cities.lower()), (2, cities.upper()), (3, NAMED.replace("Mary", "Anna")), (4, NAMED.replace("Mary", "Anna").lower())]
    short = "Mary gave every apple to my sister. Now Mary has none"
    docs += [(5, short.replace("Mary", "Anna")), (6, "Anna gave every apple to my brother. Now Anna has none")]
    assert pairs(spark, docs, [(20, cities), (21, NAMED), (22, short)]) == {
        (1, 20): False, (2, 20): False, (3, 21): True, (5, 22): True}


def test_one_clash_costs_its_windows_only(spark):
    way = ("the bus drives 60 km to the town and then it goes 2 km to the lake where 3 boys and 4 girls wait "
           "while another 3 boys and 9 dogs walk 7 km along the shore")
    merged = way.replace("3 boys", "5 boys").replace("4 girls", "5 girls").replace("60", "80").replace("2 km", "6 km").replace("9", "8")
    unit = way.replace("2 km", "1 miles").replace("60", "80").replace("3", "6").replace("4", "1").replace("9", "7").replace("7 km", "9 km")
    edited = way.replace("another 3", "another 8")
    docs = [(1, merged), (2, unit), (3, edited), (4, merged.replace("another 5", "another 8"))]
    assert pairs(spark, docs, [(20, way)]) == {(1, 20): True, (2, 20): True, (3, 20): True}
