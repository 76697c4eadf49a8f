"""File formats, frozen tables, whole builds, the streaming job."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.functions.staging import shared_folder, stage
from labelloom.functions.text import ANY_SCRIPT
from labelloom.operators import integrity, splits, weak
from labelloom.operators.rules import Rule
from labelloom.plans import corpus_freeze as CF
from labelloom.plans import evaluation as P
from labelloom.sources import corpora, tables
from labelloom.streaming.labelling import label_stream

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("text", "source", "keyword_category")])


def test_json_array_keeps_positions_and_pools(spark, tmp_path):
    for name, n in (("b.json", 3), ("a.json", 2)):
        rows = [{"text": f"{name} {i}\n\"q\"", "source": "s", "keyword_category": "k"} for i in range(n)]
        (tmp_path / name).write_text(json.dumps(rows, ensure_ascii=False, indent=1), encoding="utf-8")
    files = [str(tmp_path / n) for n in ("b.json", "a.json")]
    parts = [(f, corpora.read_json_array(spark, f, SCHEMA)) for f in files]
    pooled = corpora.pool(parts).orderBy("id").collect()
    assert [(r.id, r.src_file, r.row_no) for r in pooled] == [
        (1, "b.json", 0), (2, "b.json", 1), (3, "b.json", 2), (4, "a.json", 0), (5, "a.json", 1)]
    assert pooled[0].text == 'b.json 0\n"q"'


def test_broken_json_stops_the_read(spark, tmp_path):
    (tmp_path / "x.json").write_text("[{]")
    with pytest.raises(Exception):
        corpora.read_json_array(spark, str(tmp_path / "x.json"), SCHEMA).collect()


def test_tsv_dialects(spark, tmp_path):
    rows = [("1", 'say "hi', "back\\slash", ""), ("2", "tab\there", "line\nend", None), ("3", " lead ", "trail ", "NA")]
    df = spark.createDataFrame(rows, "id string, a string, b string, c string")
    corpora.write_tsv(df, str(tmp_path / "t"))
    got = corpora.read_tsv(spark, str(tmp_path / "t"), df.columns).orderBy("id").collect()
    assert [tuple(r) for r in got] == [
        ("1", 'say "hi', "back\\slash", ""), ("2", "tab here", "line end", ""), ("3", " lead ", "trail ", "NA")]
    corpora.write_manifest_tsv(df, str(tmp_path / "m"))
    back = corpora.read_manifest_tsv(spark, str(tmp_path / "m"), df.columns).orderBy("id").collect()
    assert [tuple(r) for r in back] == [tuple("" if v is None else v for v in r) for r in rows]


def test_staging_uses_the_shared_folder_of_the_session(spark):
    folder = shared_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    staged = stage(spark.range(5), "five")
    assert staged.count() == 5 and folder in staged.inputFiles()[0]


def test_add_dataset_proves_old_tables_unchanged(spark, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    spark.range(10).write.parquet(old)
    recorded = spark.createDataFrame(tables.table_digests(spark, {"old": old}).collect())
    digests = {r.name: r.n_rows for r in tables.add_dataset({"old": old}, recorded, "new", spark.range(3), new).collect()}
    assert digests == {"old": 10, "new": 3} and spark.read.parquet(new).count() == 3
    with pytest.raises(RuntimeError, match="already stored"):
        tables.add_dataset({"old": old}, recorded, "new", spark.range(3), new)
    spark.range(1).write.mode("append").parquet(old)
    with pytest.raises(RuntimeError, match="frozen tables changed: old"):
        tables.add_dataset({"old": old}, recorded, "other", spark.range(3), str(tmp_path / "other"))
    with pytest.raises(RuntimeError, match="frozen tables changed: new"):
        tables.add_dataset({"new": new}, recorded, "other", spark.range(3), str(tmp_path / "other"))
    assert not (tmp_path / "other").exists()


def test_of_two_writers_one_wins(spark, tmp_path):
    """Both find nothing and write; one table is stored and the other writer is told."""
    from concurrent.futures import ThreadPoolExecutor

    from labelloom.functions.staging import publish
    from labelloom.operators import selection

    for k in range(3):
        path = str(tmp_path / f"t{k}")
        with ThreadPoolExecutor(4) as pool:
            won = list(pool.map(lambda i, path=path: publish(spark.createDataFrame([(i,)], "i int"), path), range(4)))
        assert sum(won) == 1 and [r.i for r in spark.read.parquet(path).collect()] == [won.index(True)]
    path = str(tmp_path / "selection")

    def choose(i):
        try:
            selection.write_once(spark.createDataFrame([("best", f"m{i}", "h")], "name string, chosen string, inputs_sha256 string"), path)
        except RuntimeError as e:
            return str(e)
        return "stored"

    with ThreadPoolExecutor(2) as pool:
        said = list(pool.map(choose, range(2)))
    assert sorted(x == "stored" for x in said) == [False, True] and "choice changed" in "".join(said)
    assert spark.read.parquet(path).first().chosen == f"m{said.index('stored')}"


def test_reattach(spark):
    texts = spark.createDataFrame([("Hello  world!",), ("unknown",)], "text string")
    uid = texts.select(corpora.text_id("text", ANY_SCRIPT).alias("uid")).first().uid
    published = spark.createDataFrame([(uid, "pos"), ("0" * 64, "neg")], "uid string, label string")
    matched, missing = corpora.reattach(texts, "text", published, ANY_SCRIPT)
    assert [(r.text, r.label) for r in matched.collect()] == [("Hello  world!", "pos")]
    assert [r.label for r in missing.collect()] == ["neg"]


LEX = {"bad": ["awful", "bad"], "good": ["nice", "fine"]}
RULES = [Rule("bad", 0, needs=("bad",)), Rule("two", 1, entries=(("bad",), 2)), Rule("good", 2, needs=("good",), without=("bad",))]


def build(spark):
    words = ["awful", "nice", "plain", "bad", "fine"]
    rows = []
    for i in range(200):
        t = f"{words[i % 5]} {words[(i // 5) % 5]} w{chr(97 + i % 26)}x{chr(97 + (i // 26))}"
        final = "HATE" if i % 5 in (0, 3) else "NEUTRAL"
        rows.append((i, t, final, final, "NEUTRAL", final, "majority_vote", "s", "k"))
    rows.append((200, rows[0][1].upper(), "HATE", "HATE", "HATE", "HATE", "full_agreement", "s", "k"))
    rows.append((201, rows[1][1], "OFFENSIVE", "HATE", "HATE", "OFFENSIVE", "majority_vote", "s", "k"))
    return spark.createDataFrame(
        rows, "id int, text string, ws_label string, gpt_label string, llama_label string, final_label string, "
        "method string, source string, keyword_cat string")


PLAN = CF.CorpusPlan(lexicons=LEX, rules=RULES, profile=ANY_SCRIPT)


def test_whole_build(spark, tmp_path):
    out = CF.freeze_corpus(build(spark), PLAN)
    m = CF.write_frozen(out, str(tmp_path / "frozen"), PLAN)
    assert m.count() == 199                                   # one duplicate, one conflicting pair gone
    assert m.select("uid").distinct().count() == 199
    assert {r.split: r["count"] for r in m.groupBy("split").count().collect()} == {"train": 159, "val": 20, "test": 20}
    assert {c for c in m.columns} >= {
        "uid", "orig_id", "split", "label3", "label_bin", "label3_v1", "labelb_v1", "ws_v2", "ws_v2_conf",
        "ws_novote", "ws_v1", "gpt_label", "llama_label", "method_v2", "method_v1", "source", "keyword_cat",
        "raw_sha256", "text"}
    novote = m.filter("ws_novote = 1")
    assert novote.filter("ws_v2 <> 'NEUTRAL' or ws_v2_conf <> 0").count() == 0 and novote.count() > 0
    flips = {r.split: r.n for r in out["flips"].collect()}
    assert flips == {"train": 159, "val": 20, "test": 20, "all": 199}
    assert out["dedup"].first().rows_out == 199
    assert out["drift"].first().n_rules == 3
    with pytest.raises(Exception):
        CF.write_frozen(out, str(tmp_path / "frozen"), PLAN)


def test_auxiliary_and_fold_corpora(spark):
    main = CF.freeze_corpus(build(spark), PLAN)["manifest"]
    pool = build(spark).filter("id < 100").select("id", "text", F.when(F.col("id") % 2 == 0, "neg").otherwise("pos").alias("label"), F.lit("f.json").alias("src_file"))
    aux = CF.freeze_auxiliary(pool, main, ["neg", "pos"], profile=ANY_SCRIPT).collect()
    held = {r.uid for r in main.filter("split <> 'train'").collect()}
    everyone = {r.uid for r in main.collect()}
    assert len(aux) == 100
    assert all(r.collides_hs_any == (r.uid in everyone) and r.mtl_exclude == (r.uid in held) for r in aux)
    for group in (None, "mhamed"):
        folds = CF.freeze_folds(pool, ["neg", "pos"], k=5, profile=ANY_SCRIPT, group=group)
        check = splits.fold_partition_check(folds, "uid", 5).first()
        assert (check.n_keys, check.never_tested, check.tested_twice) == (100, 0, 0)
        leaks = integrity.leakage_by_fold(folds, integrity.representation_keys("text", ANY_SCRIPT), "parts", 5)
        strict = leaks if group else leaks.filter("view <> 'mhamed'")
        assert strict.agg(F.sum("n_shared")).first()[0] == 0


def test_report_and_markdown(spark):
    rows = [(s, sd, f"u{i}", i % 2, [0.4, 0.6] if (i + k + sd) % (3 + k) else [0.6, 0.4])
            for k, s in enumerate(("a", "b")) for sd in (1, 2, 3) for i in range(40)]
    p = spark.createDataFrame(rows, "system string, seed int, uid string, y int, probs array<double>")
    systems = P.system_report(p, 2)
    comps = P.comparison_report(p, [("a", "b")], 2, 100, 40)
    c = comps.first()
    assert len(c.mcnemar) == 3 and c.p_holm == pytest.approx(c.p)
    md = tables.markdown_report("binary", systems, comps)
    order = [line.split("|")[2].strip() for line in md.splitlines() if line.startswith(("| 1 ", "| 2 "))]
    best = [r.system for r in systems.orderBy(F.desc("macro_f1_mean")).collect()]
    assert order == best and "| a | b |" in md and "McNemar" in md


def test_task_report_is_written(spark, tmp_path):
    rows = [(s, sd, f"u{i}", i % 2, [0.4, 0.6] if (i + k + sd) % (3 + k) else [0.6, 0.4])
            for k, s in enumerate(("a", "b")) for sd in (1, 2) for i in range(30)]
    p = spark.createDataFrame(rows, "system string, seed int, uid string, y int, probs array<double>")
    ens = P.materialise_ensemble(p.withColumn("split", F.lit("test")), ["a", "b"], "uniform_prob_mean", 2, "ens")
    every = p.unionByName(ens.select(*p.columns))
    report = P.task_report(every, [("ens", "a"), ("a", "b")], 2, [1, 2], 100, 30, replicates=100)
    tables.write_report("binary", report, str(tmp_path))
    systems = spark.read.json(str(tmp_path / "binary" / "systems"))
    assert systems.count() == 3 and systems.filter("boot_lo <= macro_f1_mean and macro_f1_mean <= boot_hi").count() == 3
    assert spark.read.json(str(tmp_path / "binary" / "classes")).count() == 6
    md = "\n".join(r.value for r in spark.read.text(str(tmp_path / "binary" / "markdown")).collect())
    assert "| ens | a |" in md and md.startswith("# Task binary")
    assert ens.selectExpr("max(abs(logits[0] - ln(probs[0])))").first()[0] < 1e-9


def test_stream_labels_like_the_batch(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    batch = build(spark).select("id", "text")
    batch.repartition(3).write.parquet(src)
    weights = [1.0, 2.0, 0.5]
    stream = spark.readStream.schema(batch.schema).parquet(src)
    labelled = label_stream(stream, "text", ["id"], LEX, RULES, weights, 3, 2, ANY_SCRIPT)
    q = labelled.writeStream.format("parquet").option("checkpointLocation", cp).trigger(availableNow=True).start(out)
    assert q.awaitTermination(120)
    got = spark.read.parquet(out)
    want = label_stream(batch, "text", ["id"], LEX, RULES, weights, 3, 2, ANY_SCRIPT)
    cols = ["id", "uid", "mv_label", "wv_label", "wv_conf"]
    assert got.select(cols).orderBy("id").collect() == want.select(cols).orderBy("id").collect()
    assert weak.matrix_summary(got).first().n_texts == 202


def test_task_loader_proves_before_it_opens(spark):
    from labelloom.functions.text import ANY_SCRIPT, text_id
    from labelloom.plans.task_loader import load_task, manifest_digest

    texts = ["first words here", "second words there", "third other words", "fourth last words"]
    rows = [(t, s, y, f) for t, s, y, f in zip(texts, ("train", "train", "val", "test"), ("a", "b", "a", "b"), (1, 0, 1, 1))]
    base = spark.createDataFrame(rows, "text string, split string, label string, flag int")
    m = base.select(text_id("text", ANY_SCRIPT).alias("uid"), F.sha2("text", 256).alias("raw_sha256"), "*")
    load = lambda df, **more: load_task(df, "label", ["b", "a"], profile=ANY_SCRIPT, **more)
    task = load(m, recorded=manifest_digest(m))
    assert {p: sorted((r.text, r.y) for r in t.collect()) for p, t in task.items()} == {
        "train": [(texts[0], 1), (texts[1], 0)], "val": [(texts[2], 1)], "test": [(texts[3], 0)]}
    assert [r.text for r in load(m, without_flag="flag")["train"].collect()] == [texts[1]]
    with pytest.raises(ValueError, match="digest"):
        load(m.withColumn("text", F.upper("text")), recorded=manifest_digest(m))
    with pytest.raises(ValueError, match="more than once"):
        load(m.unionByName(m.limit(1)))
    copied = m.withColumn("text", F.when(F.col("split") == "test", texts[0]).otherwise(F.col("text")))
    with pytest.raises(AssertionError, match="train&test"):
        load(copied)
    with pytest.raises(ValueError, match="not declared"):
        load_task(m, "label", ["a"], profile=ANY_SCRIPT)
