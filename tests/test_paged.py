"""The paged source: how many pages are asked for, and what gaps become."""

import json

from tessera.sources import files
from tessera.sources.paged import paged_source


def crawl(folder, pages):
    for number, body in pages.items():
        place = folder / f"number={number}"
        place.mkdir(parents=True)
        (place / "part-0.txt").write_bytes(body if isinstance(body, bytes) else (json.dumps(body) + "\n").encode())
        (place / "_marker").write_text("x")


def page(number, total, n):
    return {"response": {"header": {"resultCode": "00"}, "body": {"pageNo": number, "totalCount": total, "items": {"item": [{"id": i} for i in range(n)]}}}}


def scanned(spark, folder, **options):
    spark.dataSource.register(paged_source())
    rows = spark.read.format("paged").options(path=str(folder), pageSize=10, **options).load()
    return {r.number: (r.outcome, r.n_items) for r in files.paged_items(rows)[0].collect()}, rows.rdd.getNumPartitions()


def test_the_first_total_fixes_the_scan(spark, tmp_path):
    """A page in the middle is gone, one cannot be decoded, one tells another total, and one beyond the first total is never asked for."""
    crawl(tmp_path / "a", {1: page(1, 45, 10), 2: page(2, 9000, 10), 4: b"\xff\xfe", 5: page(5, 45, 5), 6: page(6, 45, 1)})
    found, parts = scanned(spark, tmp_path / "a", pagesPerTask=2)
    assert found == {1: ("SUCCESS", 10), 2: ("SUCCESS", 10), 3: ("TRANSPORT_ERROR", None), 4: ("TRANSPORT_ERROR", None), 5: ("SUCCESS", 5)}
    assert parts == 3


def test_without_a_first_page(spark, tmp_path):
    crawl(tmp_path / "b", {2: page(2, 45, 10)})
    assert scanned(spark, tmp_path / "b")[0] == {1: ("TRANSPORT_ERROR", None)}
    crawl(tmp_path / "c", {1: {"odd": 1}})
    assert scanned(spark, tmp_path / "c")[0] == {1: ("CONTRACT_ERROR", None)}
    crawl(tmp_path / "d", {1: page(1, 0, 0)})
    assert scanned(spark, tmp_path / "d")[0] == {1: ("SUCCESS", 0)}
