"""JSON lists read in parts against Python's reader."""

import json
import random

import pytest

from haggle.sources import files, json_split

TEXTS = ["a", "}", "{[", "\\", '"', "x\ny", "é한", "]}", "", '","items":[{"', "\\}"]


def shown(v):
    return v if isinstance(v, str) or v is None else json.dumps(v, separators=(",", ":"), ensure_ascii=False)


@pytest.mark.parametrize("block", ["128m", "1k"])
def test_parts_give_the_list(spark, tmp_path, block):
    rng = random.Random(1)
    text = lambda: rng.choice(TEXTS)
    one = lambda: {k: rng.choice([text(), 1, None, True, {"n": text(), "l": [{"q": text()}, []]}, [text(), {"z": 1}]]) for k in rng.sample(["name", "price", "x", 'y"k', "items"], rng.randrange(0, 5))}
    rows = [one() for _ in range(400)]
    docs = {
        "list": (rows, rows), "empty": ([], []), "items": ({"meta": {"items": [{"no": 1}]}, "data": [{"no": 2}], "items": rows, "rows": [{"no": 3}]}, rows), "last": ({"a": 1, "products": rows[:50], "z": [{"no": 1}]}, rows[:50]),
        "no_list": ({"items": {"x": [1]}, "data": rows[:5]}, rows[:5]), "first_is_empty": ({"data": [{"no": 1}], "items": []}, []), "scalars": ([1, {"a": 1}, "x", [{"b": 2}], {"c": 3}, None], [{"a": 1}, {"c": 3}]),
    }
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for name, (doc, want) in docs.items():
            path = tmp_path / f"{name}.json"
            path.write_text(json.dumps(doc, ensure_ascii=False, indent=1 if name == "last" else None), encoding="utf-8")
            got = [{k: v for k, v in r.fields.items()} for r in files.json_rows(spark, str(path)).orderBy("ord").collect()]
            assert got == [{k: shown(v) for k, v in w.items()} for w in want], name
        if block == "1k":
            assert json_split._rows(spark, str(tmp_path / "list.json")).rdd.getNumPartitions() > 10
        (tmp_path / "bad.json").write_text('{"a":[{"b":1}]}')
        with pytest.raises(Exception, match="unsupported JSON import shape"):
            files.json_rows(spark, str(tmp_path / "bad.json")).collect()
        (tmp_path / "none.json").write_text("")
        with pytest.raises(ValueError):
            files.json_rows(spark, str(tmp_path / "none.json"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
