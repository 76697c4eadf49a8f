"""JSON arrays read in byte ranges."""

import json
import random

import pytest
from pyspark.sql import types as T

from labelloom.functions.staging import fresh_path
from labelloom.sources import json_arrays as J

NASTY = ['a"b', "back\\", "\\\\\"", "{[", "]}", "é日𝒳", "", "line\nend", "\\\"{", "\\" * 7]


def array(seed):
    r = random.Random(seed)
    rows = [{"text": "".join(r.choice(NASTY) for _ in range(r.randint(0, 6))), "n": i, "deep": {"x": [{"y": r.choice(NASTY)}, []]}}
            for i in range(r.randint(0, 40))]
    return rows, json.dumps(rows, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1])).encode()


@pytest.mark.parametrize("seed", range(30))
def test_every_cut_gives_every_record_once(seed):
    """Ranges of any size, beginning inside strings, after backslashes and inside characters."""
    rows, data = array(seed)
    r = random.Random(seed)
    split, step = r.choice([1, 2, 3, 7, 50, 1000]), r.choice([1, 5, 64])
    state, depth, row, got = J.OUTSIDE, 0, 0, []
    for start in range(0, len(data), split):
        piece = data[start : start + split]
        own = list(J.cut(lambda at, n: data[at : at + n], start, len(piece), state, depth, step))
        ends = {s: J.scan(piece, s) for s in (J.OUTSIDE, J.INSIDE, J.ESCAPED)}
        assert sum(n for d, n in ends[state][2].items() if d + depth == 1) == len(own)
        got += own
        state, depth = ends[state][0], depth + ends[state][1]
    assert [json.loads(g) for g in got] == rows and (state, depth) == (J.OUTSIDE, 0)


def test_an_unfinished_record_is_told():
    with pytest.raises(ValueError, match="does not end"):
        list(J.cut(lambda at, n: b'[{"a": 1'[at : at + n], 0, 8, J.OUTSIDE, 0))


def test_files_are_read_by_many_tasks_in_order(spark):
    rows = [(i, NASTY[i % len(NASTY)] * (i % 50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "n long, text string")
    path = fresh_path(spark, "arrays")
    J.write_json_array(df.coalesce(1), path)
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("text", T.StringType())])
    back = J.read_json_array(spark, path, schema, split=9_000)
    got = back.collect()
    assert sorted((r.n, r.text) for r in got) == rows and all(r.row_no == r.n for r in got)
    assert len({r.path for r in got}) == 1 and back.rdd.getNumPartitions() > 4
    J.write_json_array(df.limit(0), path + "-none")
    assert J.read_json_array(spark, path + "-none", schema).collect() == []
