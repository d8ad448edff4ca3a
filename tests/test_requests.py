"""Bulk requests: what they share is summed and listed once, in tasks of a bounded size."""

import re

import pytest

from tidemark.operators import requests
from tidemark.sources.projection import project

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return project(spark, SF)


def ask(spark, rows):
    return spark.createDataFrame(rows, requests.REQUEST)


def test_many_requests_make_more_tasks(spark, tables, monkeypatch):
    asked = ask(spark, [(i, 1 + i % 2, "weeks-in-top-n", 1 + i % 20, None, 1996 + i % 5, None, None, i // 20 % 4, False, 5) for i in range(400)])
    whole = sorted(map(tuple, requests.requested_records(tables, asked).collect()))
    monkeypatch.setattr(requests, "TASK_ROWS", 2000, raising=False)
    found = requests.requested_records(tables, asked)
    plan = found._jdf.queryExecution().toString()
    assert max(map(int, re.findall(r"Exchange hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", plan)), default=0) > spark.sparkContext.defaultParallelism
    assert len(whole) > 1000 and sorted(map(tuple, found.collect())) == whole


def test_like_requests_have_a_list_each(spark, tables):
    row = (1, "total-weeks", 3, None, None, None, None, None, None, None)
    one = [tuple(r)[1:] for r in requests.requested_records(tables, ask(spark, [(1, *row)])).orderBy("rank").collect()]
    found = requests.requested_records(tables, ask(spark, [(1, *row), (2, *row), (2, *row), (3, *row[:-1], 7), (4, 1, "nothing known", *row[2:]), (5, 9, *row[1:])])).collect()
    lists = {i: sorted(tuple(r)[1:] for r in found if r["request_id"] == i) for i in range(1, 6)}
    assert len(one) == 50 and lists[1] == one and lists[2] == sorted(one * 2) and lists[3] == one[:7] and not lists[4] and not lists[5]
