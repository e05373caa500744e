"""A small source corpus with known answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MINI = {
    "app.py": "import core.util\nfrom core.store import Store\n\ndef main():\n    s = Store()\n    load(s)\n    save(s)\n\ndef load(s):\n    parse(s)\n    save(s)\n\ndef save(s):\n    flush(s)\n\ndef parse(s):\n    parse(s)\n",
    "core/store.py": "class Store:\n    def get(self):\n        return 1\n",
    "core/util.py": "VERSION = 1\n",
    "tests/test_app.py": "from app import load\ndef test_load():\n    load(None)\n",
}


def files(spark: SparkSession, content: dict[str, str] = MINI) -> DataFrame:
    return spark.createDataFrame(sorted(content.items()), "path string, content string")
