"""Archives: exact round trips, pushed predicates, skipped payloads, revisits against a plain loop, commits."""

import gzip
import hashlib
import io
import json
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewatch.llm import warc
from tidewatch.llm.common import scratch_dir

VALUES = st.text(st.sampled_from("ab %\r\n\t\x00é中:<>\x85 "), min_size=1, max_size=12)
RECORDS = st.lists(st.tuples(st.sampled_from(["response", "resource", "metadata", "revisit"]), VALUES, st.binary(max_size=40) | st.just(b"WARC/1.1\r\n\r\n")), max_size=6)


def parse(data, payload=True, predicates=(), errors="raise"):
    reader = warc.WarcReader({"path": "/x", "payload": str(payload), "errors": errors}, warc.WarcSource({"payload": str(payload)}).schema())
    reader.predicates = list(predicates)
    return list(reader._records(io.BufferedReader(io.BytesIO(data)), "x"))


@pytest.mark.parametrize("pack", [lambda d: d, warc.gzip_member, gzip.compress])
@settings(max_examples=120, deadline=None)
@given(RECORDS)
def test_records_come_back(pack, records):
    data = b"".join(pack(warc.record_bytes({"record_type": kind, "target_uri": uri, "record_id": f"<urn:{i}>"}, {"X-Own": uri}, b"" if kind == "revisit" else payload, len(payload)))
                    for i, (kind, uri, payload) in enumerate(records))
    got = parse(data)
    assert [(r["record_type"], r["target_uri"], dict(r["headers"])["X-Own"], r.get("payload"), r["payload_bytes"]) for r in got] == [
        (kind, uri, uri, None if kind == "revisit" else payload, len(payload)) for kind, uri, payload in records]
    chosen = parse(data, payload=False, predicates=[ds.EqualTo(("record_type",), "response"), ds.StringStartsWith(("record_id",), "<urn:")])
    assert [r["target_uri"] for r in chosen] == [uri for kind, uri, _ in records if kind == "response"]
    assert all("payload" not in r for r in chosen)


def test_unwanted_payloads_are_not_inflated():
    blocks = [warc.record_bytes({"record_type": "response", "record_id": f"<{i}>"}, {}, os.urandom(1 << 20)) for i in range(6)]
    data = b"".join(warc.gzip_member(b) for b in blocks)
    source = warc._Members(io.BufferedReader(io.BytesIO(data)))
    inflated, seen = [], 0
    while source.begin():
        head = warc._parse_head(source)
        seen += 1
        inflated.append(len(source._ready))
        source.leave(head.length)
    assert seen == 6 and max(inflated) < 4096
    assert [r["record_id"] for r in parse(data, predicates=[ds.EqualTo(("record_id",), "<4>")])] == ["<4>"]


@pytest.mark.parametrize("predicate,want", [
    (ds.Not(ds.EqualTo(("target_uri",), "u")), ["b"]), (ds.Not(ds.IsNull(("target_uri",))), ["a", "b"]), (ds.IsNull(("target_uri",)), ["c"]),
    (ds.In(("target_uri",), ("u", "z")), ["a"]), (ds.EqualNullSafe(("target_uri",), None), ["c"]), (ds.StringContains(("target_uri",), "v"), ["b"]),
    (ds.Not(ds.IsNotNull(("target_uri",))), ["c"]), (ds.StringEndsWith(("record_id",), "a"), ["a"])])
def test_predicates(predicate, want):
    data = b"".join(warc.record_bytes({"record_type": "resource", "record_id": i, "target_uri": u}, {}, b"x") for i, u in (("a", "u"), ("b", "v"), ("c", None)))
    assert warc.answerable(predicate)
    assert [r["record_id"] for r in parse(data, predicates=[predicate])] == want


def test_damage():
    good = warc.record_bytes({"record_type": "resource", "record_id": "a"}, {}, b"payload")
    for bad in (b"NOT A RECORD\r\n", good[:-12], b"WARC/1.1\r\nWARC-Type: x\r\n\r\n", b"WARC/1.1\r\nContent-Length: 3"):
        with pytest.raises(warc.DamagedRecord):
            parse(good + bad)
        assert [r["record_id"] for r in parse(good + bad, errors="skip")] == ["a"]
    with pytest.raises(warc.DamagedRecord):
        parse(warc.gzip_member(good)[:-30])
    with pytest.raises(ValueError):
        warc.record_bytes({}, {"a b": "c"}, b"")


SCHEMA = "page_id long, url string, html string, payload string, digest string, first long"


def pages(spark):
    long, hot = "x" * 300, "hot " * 40
    found = [(i, f"http://a/{i}", hot) for i in range(5, 400)]
    found += [(1, "u\r\nWARC-Type: metadata", long), (2, None, long), (3, "", None), (4, "%0A", ""), (500, "é", "short"), (501, "e", "short"), (None, "n", long),
              (None, "n", "y" * 200), (None, "n", "y" * 200), (502, "r", "z" * 100), (502, "r", "z" * 100), (503, "s", "z" * 100), (504, "t", "w" * 99), (505, "t", "w" * 99),
              (506, "big", "ü" * 400_000)]
    return [(a, b, c, "p", "d", 0) for a, b, c in found]


def plain_verdicts(found):
    out = []
    for page, _, html, *_ in found:
        data = (html or "").encode()
        keys = [p for p, _, other, *_ in found if (other or "").encode() == data and p is not None]
        first = min(keys) if keys and len(data) >= 100 else page
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "response" if first == page else "revisit", None if first == page else first))
    return sorted(out, key=str)


def read_back(spark, path):
    found = warc.read(spark, path)
    found = found.select(warc.key_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.key_of(F.col("refers_to")).alias("refers_to"), "payload", "target_uri")
    return found.collect()


@pytest.mark.parametrize("options", [{"compression": "gzip", "file_bytes": "3000"}, {"compression": "none"}])
def test_pages(spark, options):
    path, found = scratch_dir(spark, "warc-test"), pages(spark)
    docs = spark.createDataFrame(found, SCHEMA).repartition(3)
    warc.write(warc.page_records(docs), path, **options)
    got = read_back(spark, path)
    assert sorted([tuple(r)[:5] for r in got], key=str) == plain_verdicts(found)
    urls = {(p, u, (h or "").encode()) for p, u, h, *_ in found}
    assert all((r["page_id"], r["target_uri"], bytes(r["payload"])) in urls for r in got if r["record_type"] == "response")
    # Predicates on headers leave the plan; files of an uncommitted task are not read; further writes append.
    narrow = warc.read(spark, path, payload=False, partition_bytes="2000").where("record_type = 'revisit' AND target_uri LIKE 'http:%'")
    assert narrow.rdd.getNumPartitions() > 1 or options["compression"] == "none"
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert " Filter (" not in plan and "payload#" not in plan
    assert narrow.count() == sum(r["record_type"] == "revisit" and (r["target_uri"] or "").startswith("http:") for r in got)
    folder = path.removeprefix("file://")
    with open(f"{folder}/part-lost.warc", "wb") as lost:
        lost.write(b"WARC/1.1\r\n")
    assert warc.read(spark, path).count() == len(found)
    warc.write(warc.page_records(docs.where("page_id = 506")), path)
    assert warc.read(spark, path).count() == len(found) + 1
    assert set(json.load(open(f"{folder}/_manifest.json"))) < set(os.listdir(folder))


def test_other_archives(spark, tmp_path):
    """A folder without a manifest, one file, members without their length, and an empty table."""
    record = warc.record_bytes({"record_type": "warcinfo", "record_id": "<i>"}, {"A": "b"}, b"software: x\r\n")
    (tmp_path / "a.warc").write_bytes(record * 2)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    (tmp_path / "c.txt").write_bytes(b"no")
    assert rows(warc.read(spark, str(tmp_path)), "record_type", "payload_bytes") == [("warcinfo", 13)] * 4
    assert warc.read(spark, f"file://{tmp_path}/a.warc").select("headers").first()[0] == {"A": "b"}
    path = scratch_dir(spark, "warc-empty")
    warc.write(warc.page_records(spark.createDataFrame([], SCHEMA)), path)
    assert warc.read(spark, path).count() == 0
