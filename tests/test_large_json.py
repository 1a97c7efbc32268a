import json
import random

from tandem.sources import catalog


def cells(rng):
    text = "".join(rng.choice(['"', "\\", "],[", "},\"", "{", "}", "]", "[", ",", "é", "x", "\n", "]]}"]) for _ in range(rng.randrange(0, 7)))
    return [rng.randrange(1000), text, rng.choice([None, "a", 7]), text[::-1]]


def compact(value):
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def split(spark):
    """Byte ranges of a few hundred bytes, so that a small file stands for a large one."""
    for key, value in (("maxPartitionBytes", "300"), ("openCostInBytes", "0"), ("minPartitionNum", "1")):
        spark.conf.set(f"spark.sql.files.{key}", value)


def whole(spark):
    for key in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{key}")


def test_snapshot_files_are_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(3)
    want = []
    for i, n in enumerate((400, 1, 0, 25)):
        rows = [cells(rng) for _ in range(n)] if i < 3 else [[j, "plain", None, "z"] for j in range(n)]
        doc = {"hasta": f"h{i}", "completoEn": "c", "cols": ["id", "t", "n", "r"], "filas": rows}
        (tmp_path / f"s{i}.json").write_text(compact(doc) + ("\n" if i % 2 else ""), "utf-8")
        want += [(f"h{i}", str(a), t, None if x is None else str(x), None) for a, t, x, _ in rows]
    split(spark)
    try:
        got = catalog.snapshot_rows(spark, str(tmp_path), ["id", "t", "n", "absent"])
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
        one = catalog.json_pieces(spark, str(tmp_path / "s0.json"), "],[")
        assert spark.read.option("lineSep", "],[").text(str(tmp_path / "s0.json")).rdd.getNumPartitions() > 20 and one.count() == 400
    finally:
        whole(spark)
    # the same rows as a file read as one string
    strings = spark.read.text(str(tmp_path / "s0.json"), wholetext=True)
    assert sorted(map(repr, map(tuple, catalog.decode_snapshot(strings, ["id", "t", "n", "absent"]).collect()))) == sorted(
        repr(w) for w in want if w[0] == "h0")


def test_cache_files_are_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(4)
    want = set()
    for i, n in enumerate((300, 1, 0)):
        cache = {f"k{i}-{j}": {lang: cells(rng)[1] + rng.choice(["", "},", "}"]) for lang in rng.sample(["en", "pt", "fr"], rng.randrange(1, 4))} for j in range(n)}
        (tmp_path / f"c{i}.json").write_text(compact(cache) + "\n", "utf-8")
        want |= {(k, lang, t) for k, by in cache.items() for lang, t in by.items()}
    split(spark)
    try:
        got = [tuple(r) for r in catalog.translation_rows(spark, str(tmp_path)).collect()]
    finally:
        whole(spark)
    assert len(got) == len(want) and set(got) == want
