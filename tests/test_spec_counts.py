"""Requirements by status over every stored shape of a result, by hand and against brute force."""
import datetime
import json
import os

import pytest

from tessella.plans import service_queries as S
from tessella.sources.tables import table

DATA = "/root/testdata/sf0.01"


def counted(items):
    status = [x.get("status") for x in items]
    done, some = status.count("implemented"), status.count("partial")
    return done, some, status.count("missing"), done + some, len(items), done * 100 // len(items)


def read(text):
    """The requirements of a result, by the JSON module."""
    for _ in range(4):
        try:
            text = json.loads(text) if isinstance(text, str) else text
        except ValueError:
            return []
        text = text["requirements"] if isinstance(text, dict) and "requirements" in text else text
    items = text if isinstance(text, list) else [text]
    return [x for x in items if isinstance(x, dict) and x]


def got(spark, folder):
    return {r.id: tuple(r)[1:] for r in S.spec_counts(spark, folder).collect()}


def test_every_shape(spark, tmp_path):
    one, two = {"id": "REQ-1", "status": "implemented"}, {"id": "REQ-2", "status": "missing"}
    shapes = {"array": json.dumps([one, two]), "envelope": json.dumps({"requirements": [one, two]}), "single": json.dumps(one), "text": json.dumps(json.dumps([one, two])), "empty": "[]", "broken": "[{", "nothing": None}
    day = datetime.datetime(2026, 1, 1)
    rows = [(k, v, day) for k, v in shapes.items()] + [("array", json.dumps([two]), day - datetime.timedelta(1))]
    spark.createDataFrame(rows, "id string, result_json string, created_at timestamp").write.parquet(f"{tmp_path}/spec_results.parquet")
    both = (1, 0, 1, 1, 2, 50)
    assert got(spark, str(tmp_path)) == {"array": both, "envelope": both, "text": both, "single": (1, 0, 0, 1, 1, 100)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_brute_force(spark):
    want = {}
    for r in sorted(table(spark, DATA, "spec_results").select("id", "created_at", "result_json").where("id is not null").collect(), key=lambda r: (r.id, r.created_at)):
        want[r.id] = read(r.result_json)
    assert got(spark, DATA) == {k: counted(v) for k, v in want.items() if v}
