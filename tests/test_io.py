import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from lexiloom.operators.augment import AugmentConfig
from lexiloom.operators.dedup import DedupConfig
from lexiloom.plans import config, pipeline
from lexiloom.sources import readers, writers
from lexiloom.streaming import stream


def test_paths(tmp_path, monkeypatch):
    for n in ("b.txt", "a.txt", "_own", "_SUCCESS", ".a.txt.crc"):
        (tmp_path / n).write_text("x")
    monkeypatch.setenv("HERE", str(tmp_path))
    assert [os.path.basename(p) for p in readers.expand("$HERE")] == ["_own", "a.txt", "b.txt"]
    with pytest.raises(ValueError):
        readers.seen_by_spark([str(tmp_path / "_own")])
    assert [os.path.basename(p) for p in readers.expand("$HERE/*.txt")] == ["a.txt", "b.txt"]
    for missing in ("$HERE/none.txt", "$HERE/*.csv"):
        with pytest.raises(FileNotFoundError):
            readers.expand(missing)


TEXTS = {
    "unix.txt": "one\n\ntwo\nlines\n\n\nthree\n \nstill three\x0bor\u2028more\n\n",
    "dos.txt": "one\r\n\r\n  \n\ntwo\r\nlines\r\n\r\n\nend\r",
    "_own": "first\n\nsecond\n",
    "empty.txt": "",
}


@pytest.mark.parametrize("split", ["134217728", "16"])
@pytest.mark.parametrize("mode", ["line", "blank_line", "file"])
def test_text(spark, tmp_path, mode, split):
    """Documents and ordinals by the rule, written out in Python; files in one split and in many."""
    want = {}
    for name, text in TEXTS.items():
        (tmp_path / name).write_bytes(text.encode())
        docs = {"line": text.splitlines(), "blank_line": text.replace("\r\n", "\n").split("\n\n"), "file": [text]}[mode]
        want |= {f"{name}:{i}": d for i, d in enumerate(docs) if d.strip()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = readers.read_text(spark, readers.expand(str(tmp_path)), mode).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r.id: r.text for r in got} == want and len(got) == len(want)
    with pytest.raises(ValueError):
        readers.read_text(spark, [str(tmp_path / "unix.txt")], "page")


def test_hub_mirrors(spark, tmp_path):
    root = tmp_path / "set" / "snapshots" / "abc" / "ta"
    root.mkdir(parents=True)
    for name, n in (("train-0.parquet", 3), ("train-1.parquet", 4), ("test-0.parquet", 2)):
        spark.range(n).toPandas().to_parquet(root / name)
    src = {"type": "hf", "path": str(tmp_path / "set"), "revision": "abc", "config_name": "ta"}
    count = lambda **more: readers.iter_rows(spark, {**src, **more}).count()
    assert count() == 7 and count(split="test") == 2 and count(split="none") == 9
    assert count(data_files="*-0.parquet") == 5 and count(data_files={"test": ["test-*"]}, split="test") == 2
    with pytest.raises(ValueError):
        readers.iter_rows(spark, {"type": "hf"})


def test_seeded_cut_is_the_same(spark, tmp_path):
    spark.range(100).selectExpr("id % 10 as k", "id").write.parquet(str(tmp_path / "t"))
    src = {"type": "parquet", "path": str(tmp_path / "t"), "shuffle_seed": 3, "max_docs": 7}
    first = [tuple(r) for r in readers.iter_rows(spark, src).collect()]
    assert first == [tuple(r) for r in readers.iter_rows(spark, src).collect()] and len(first) == 7


def test_ratings_are_stamped(spark, tmp_path):
    from tests.test_operators import R, rating

    writers.append_ratings(spark.createDataFrame([rating(), rating(w="none")], R), str(tmp_path / "r"))
    writers.append_ratings(spark.createDataFrame([(*rating(), "2024-05-01T00:00:00+00:00")], R + ", ts string"), str(tmp_path / "r"))
    got = sorted(r.ts for r in spark.read.json(str(tmp_path / "r")).collect())
    assert len(got) == 2 and got[0].startswith("2024-05-01") and got[1].endswith("+00:00")
    assert writers.write_jsonl(spark.range(5), str(tmp_path / "j")) == 5


def test_jsonl(spark, tmp_path):
    rows = [{"id": i, "text": f"t{i}", "lang": "ta" if i % 2 else None} for i in range(10)]
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, rows)) + "\n\n")
    src = {"type": "jsonl", "path": str(tmp_path / "a.jsonl.gz"), "filter": {"field": "lang", "equals": "ta"}, "skip_docs": 1, "max_docs": 2}
    assert [r.id for r in readers.iter_rows(spark, src, "id").orderBy("id").collect()] == [3, 5]
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\nnot json\n{"id": 2}\n')
    assert readers.read_jsonl_tolerant(spark, str(tmp_path / "bad.jsonl"), "id int").where("id is not null").count() == 2
    assert readers.read_jsonl_tolerant(spark, str(tmp_path / "none.jsonl"), "id int").count() == 0
    with pytest.raises(Exception):
        readers.read_jsonl(spark, [str(tmp_path / "bad.jsonl")], "id int").collect()
    with pytest.raises(ValueError):
        readers.iter_rows(spark, {"type": "csv", "path": "x"})


def test_filters():
    assert readers.row_filter(None, []) is not None
    for bad in ({"field": "a", "like": "x"}, {"equals": 1}, {"field": "a", "equals": 1, "in": [1]}):
        with pytest.raises(ValueError):
            readers.row_filter(bad, ["a"])


def test_null_filter_and_absent_fields(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, a string")
    ids = lambda spec: {r.id for r in df.where(readers.row_filter(spec, df.columns)).collect()}
    assert ids({"field": "a", "equals": None}) == {1} and ids({"field": "zz", "equals": None}) == {1, 2} and ids({"field": "zz", "in": ["x"]}) == set()


def test_source_validation():
    with pytest.raises(ValueError):
        readers.validated([{"name": "a", "enabled": False}])
    with pytest.raises(ValueError):
        readers.validated([{"name": "a"}, {"name": "a"}])


def test_required_source_raises(spark):
    def load(src):
        raise OSError("gone")

    with pytest.raises(OSError):
        readers.union_sources(spark, [{"name": "a", "required": True}], load)


def test_config(tmp_path, monkeypatch):
    (tmp_path / "base.yaml").write_text("a: {x: 1, y: 2}\nn: 3\n")
    (tmp_path / "c.yaml").write_text("base: base.yaml\na: {y: 5}\nd: ${a.y}\ne: 'v-${n}-${env:NOPE,none}'\nf: ${mul:2,${n}}\ng: ${div:9,3}\n")
    got = config.load_config(str(tmp_path / "c.yaml"), ["a.x=7", "z=[1, 2]"])
    assert got["a"] == {"x": 7, "y": 5} and got["d"] == 5 and got["e"] == "v-3-none" and got["f"] == 6 and got["g"] == 3 and got["z"] == [1, 2]
    (tmp_path / "base.yaml").write_text("base: c.yaml\n")
    with pytest.raises(ValueError):
        config.load_config(str(tmp_path / "c.yaml"))


def documents():
    para = "இந்த ஊரில் மழை {} அதிகமாக பெய்தது மக்கள் மகிழ்ச்சியுடன் வயலில் வேலை செய்தனர் பின்னர் {} வீடு திரும்பினர் குழந்தைகள் {} விளையாடினர்"
    rows = [(i, para.format(f"நாள்{i}", f"மாலை{i * 7}", f"பந்து{i * 13}"), "s1", str(i)) for i in range(30)]
    return rows + [(30, rows[3][1] + " !", "s1", "30"), (31, None, "s2", "31"), (32, "short", "s2", "32"), (33, "Cookie Policy\nAll rights reserved", "s2", "33")]


def test_pipeline(spark, tmp_path):
    df = spark.createDataFrame(documents(), "seq long, text string, source string, source_id string")
    cfg = pipeline.PipelineConfig(
        sources={"s1": pipeline.SourceRules(lang_hint="ta", category="news")}, quality={"default": {"min_words": 5, "min_chars": 40, "max_mean_word_len": 30}},
        dedup=DedupConfig(near=False), eval_fraction=0.3, max_eval_docs=4, augment=AugmentConfig(enabled=True, tanglish_fraction=1.0),
    )
    out = str(tmp_path / "out")
    stats = pipeline.run(df, cfg, out)
    assert stats["sources"]["s1"]["seen"] == 31 and stats["sources"]["s1"]["dup_exact"] == 1 and stats["sources"]["s1"]["kept"] == 30 == stats["sources"]["s1"]["lang_kept_ta"]
    assert stats["sources"]["s2"] == {"seen": 3, "empty_after_cleaning": 2, "lang_other": 1}
    assert stats["categories"]["news"]["eval"]["docs"] == 4 and stats["categories"]["tanglish_synthetic"]["train"]["docs"] == 26
    with pytest.raises(FileExistsError):
        writers.prepare_output(out)
    writers.prepare_output(out, overwrite=True)
    shards = readers.read_shards(spark, f"{out}/corpus", "news", "eval")
    assert shards.count() == 4 and "news" in readers.available_categories(spark, f"{out}/corpus")
    assert readers.read_shards(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "foreign").mkdir()
    (tmp_path / "foreign" / "x").write_text("x")
    with pytest.raises(FileExistsError):
        writers.prepare_output(str(tmp_path / "foreign"), overwrite=True)


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_output_folders(spark, tmp_path, scheme):
    path = f"{scheme}{tmp_path}/out"
    writers.prepare_output(path)
    writers.save_json(f"{path}/other.json", {"a": "அ"})
    for overwrite in (False, True):
        with pytest.raises(FileExistsError):
            writers.prepare_output(path, overwrite)
    writers.save_json(f"{path}/{writers.STATS}", {})
    writers.prepare_output(path, overwrite=True)
    assert json.loads((tmp_path / "out" / "other.json").read_text()) == {"a": "அ"}


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_packed_tables(spark, tmp_path, scheme):
    path = f"{scheme}{tmp_path}/packed"
    with pytest.raises(FileNotFoundError):
        writers.load_packed(spark, path)
    blocks = spark.createDataFrame([(0, [1, 2])], "block long, input_ids array<int>")
    assert writers.load_packed(spark, path, lambda: writers.save_packed(blocks, path, {"seq_len": 2})).count() == 1
    from lexiloom.operators import packing

    rows = [(i, "ab"[i % 2], [i] * 5, 5) for i in range(20)] + [(99, "c", [1], 1)]
    tokens = spark.createDataFrame(rows, "id long, category string, input_ids array<int>, n_tokens int")
    said = []
    sets = packing.eval_sets(tokens, {"both": ["a", "b"], "one": ["a"], "short": ["c"], "none": ["z"]}, "id", "category", 4, 10, log=said.append)
    assert {k: v.count() for k, v in sets.items()} == {"both": 10, "one": 10} and len(said) == 2
    writers.save_packed(blocks, path, {"seq_len": 2}, sets)
    assert writers.eval_tables(path) == ["eval_both", "eval_one"] and all(len(r.input_ids) == 4 for r in writers.load_packed(spark, path, name="eval_one").collect())
    assert writers.run_metadata({"a": 1}, path)["config"] == {"a": 1}


def test_stream(spark, tmp_path):
    rows = [(i, t, "s1", str(i), f"2024-01-01 0{i % 5}:00:00") for i, t, *_ in documents()[:30]] * 2
    df = spark.createDataFrame(rows, "seq long, text string, source string, source_id string, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    cfg = pipeline.PipelineConfig(sources={"s1": pipeline.SourceRules(lang_hint="ta", category="news")})
    live = stream.documents(spark, str(tmp_path / "in"), df.schema)
    stream.write(stream.curated_stream(live, cfg, "at"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30
