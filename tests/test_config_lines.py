import json
import time

from corpuscle.operators.config import config_entries, quoted_lines


def test_a_members_line_is_the_first_with_its_quoted_name():
    text = '{"a": 1, "b": {"a": "x\\"y"},\n "c": "b",\n"d e": [{"f": null}], "": 0,\n"g": "a"}'
    lines, found = text.split("\n"), quoted_lines(text)
    for name in ("a", "b", "c", "d e", "f", "", "g", "none"):
        assert found.get(name, -1) == next((k for k, t in enumerate(lines, 1) if f'"{name}"' in t), -1), name


def test_many_members_take_one_pass(spark):
    text = json.dumps({f"k{k}": {"v": k} for k in range(60_000)}, indent=1)
    files = spark.createDataFrame([("a.json", "json", 1, text)], "path string, format string, precedence int, content string")
    began = time.time()
    rows = config_entries(files, ("json",)).where("key like '%999%'").collect()
    assert time.time() - began < 60
    at = {r.key: r.line_no for r in rows}
    assert at["k59999"] == 2 + 3 * 59_999 and at["k59999:v"] == 3
