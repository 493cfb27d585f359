"""Files of objects in byte ranges."""

import json
import random

import pytest
from pyspark.sql import functions as F

from planlake.sources import objects


def plain(text):
    """(at, text) of the top-level objects, byte by byte."""
    data, out, depth, quoted, escaped, start = text.encode(), [], 0, False, False, 0
    for i, c in enumerate(data):
        if quoted:
            if escaped:
                escaped = False
            elif c == ord("\\"):
                escaped = True
            elif c == ord('"'):
                quoted = False
        elif c == ord('"'):
            quoted = True
        elif c == ord("{"):
            if depth == 0:
                start = i
            depth += 1
        elif c == ord("}"):
            depth -= 1
            if depth == 0:
                out.append((start, data[start : i + 1].decode()))
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(3)

    def value(d):
        kind = rng.randint(0, 5 if d < 3 else 3)
        texts = ['}{"', "\\", "é日", "plain words", 'quote " and \\" {', "\n,{", ""]
        return rng.choice(texts) if kind < 2 else rng.randint(0, 99) if kind == 2 else None if kind == 3 else [value(d + 1) for _ in range(3)] if kind == 4 else {rng.choice("abc{"): value(d + 1) for _ in range(3)}

    out = tmp_path_factory.mktemp("objects")
    between = [",\n", "\n", ",", "", " \n\n, "]
    for i in range(3):
        items = [{"id": j, "v": value(0), "w": value(0)} for j in range(60)]
        shown = [json.dumps(x, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])) for x in items]
        (out / f"f{i}.txt").write_text("".join(s + rng.choice(between) for s in shown), encoding="utf-8")
    (out / "empty.txt").write_text("")
    (out / "one.txt").write_text('{"a": "' + "x" * 5000 + '"}')
    (out / "cut.txt").write_text('{"a": 1} {"b": "never closed')
    return out


@pytest.mark.parametrize("size", [7, 64, 1000, 1 << 20])
def test_objects_in_ranges(spark, folder, size):
    files = [folder / "f0.txt"] if size == 7 else sorted(folder.glob("*.txt"))
    got = sorted((r.path, r["at"], r.text) for r in objects.read_objects(spark, str(files[0] if size == 7 else folder), size).collect())
    assert got == sorted((str(f), at, text) for f in files for at, text in plain(f.read_text(encoding="utf-8")))


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "large.txt"
    with path.open("w") as f:
        for i in range(20_000):
            f.write(json.dumps({"i": i, "s": "x\\\"{" * (i % 40)}) + ",\n")
    rows = objects.read_objects(spark, f"file://{path}", 1 << 17)
    assert objects.object_ranges(spark, f"file://{path}", 1 << 17).rdd.getNumPartitions() > 8
    found = rows.select(F.from_json("text", "i int, s string").alias("o")).select("o.i", F.length("o.s").alias("n"))
    assert [tuple(r) for r in found.orderBy("i").collect()] == [(i, 4 * (i % 40)) for i in range(20_000)]


def test_a_condition_on_path_opens_no_other_file(spark, folder):
    one = str(folder / "f1.txt")
    every = objects.object_ranges(spark, str(folder), 64)
    n = every.rdd.getNumPartitions()
    for condition in (f"path = '{one}'", f"path IN ('{one}', 'x')", "path LIKE '%f1.txt'"):
        assert 0 < objects.object_ranges(spark, str(folder), 64, condition).rdd.getNumPartitions() < n / 2
    assert {r.path for r in every.where(F.col("path") == one).select("path").collect()} == {one} and every.rdd.getNumPartitions() == n
    got = objects.read_objects(spark, str(folder / "f*.txt"), 64, f"path = '{one}'")
    assert {r.path for r in got.collect()} == {one} and got.count() == 60
