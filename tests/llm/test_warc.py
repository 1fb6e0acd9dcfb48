import hashlib

import pytest

from ticketlens.llm import warc

SCHEMA = "page_id bigint, url string, html string, value string, record_id string"
LONG = "<p>" + "same payload é日🙂 " * 20


def rows():
    return [
        (5, "https://a.example/x?q=1", LONG, "v", "r"), (3, "https://b.example", LONG, "v", "r"), (9, "https://a.example/x?q=1", LONG, None, None),
        (3, "https://b.example", LONG, "v", "r"), (1, None, None, None, None), (2, "no url\r\nX: y", "", "v", "r"), (4, "u", "short", "v", "r"),
        (6, "u", "short", "v", "r"), (7, "u", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "b" * 100, "v", "r"), (None, "u", LONG, "v", "r"),
        (None, "u", "only without id " * 9, "v", "r"), (8, "u", "z" * 3_000_000, "v", "r"), (10, "u", "\r\n\r\n" * 30, "v", "r"),
    ]


def brute(pages):
    out = []
    for i, _, h, *_ in pages:
        data = (h or "").encode()
        same = [j for j, _, g, *_ in pages if (g or "") == (h or "") and j is not None]
        first = min(same) if same and len(data) >= 100 else i
        kind = "response" if i == first or not same else "revisit"
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), kind, first if kind == "revisit" else None, True, True))
    return sorted(out, key=repr)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, tmp_path, compression):
    warc.write(warc.records(spark.createDataFrame(rows(), SCHEMA)), str(tmp_path / "w"), compression, 4)
    archive = warc.read(spark, str(tmp_path / "w"), with_payload=True)
    captures = warc.assemble(archive)
    assert sorted((tuple(r) for r in warc.capture_digests(captures).collect()), key=repr) == brute(rows())
    got = {r.response.page_id: r for r in captures.collect()}
    assert got["7"].response.payload.decode() == rows()[8][2] and got["5"].response.payload == b""
    assert got["5"].request.target_uri == "https://a.example/x?q=1" and got["2"].response.target_uri == "no url%0D%0AX: y"
    assert got["1"].response.target_uri is None and got["5"].n_request == 1 and got["5"].metadata.payload_bytes > 10


def test_files_are_plain_warc(spark, tmp_path):
    warc.write(warc.records(spark.createDataFrame(rows()[:2], SCHEMA).coalesce(1)), str(tmp_path / "w"))
    data = b"".join(f.read_bytes() for f in sorted((tmp_path / "w").glob("part-*")))
    parsed = list(warc.parse(data))
    assert [h["warc-type"] for h, *_ in parsed].count("request") == 2 and data.endswith(b"\r\n\r\n")
    assert all(int(h["content-length"]) == len(b) for h, _, b in parsed)
    with pytest.raises(ValueError):
        list(warc.parse(data[:-40]))
    with pytest.raises(ValueError):
        list(warc.parse(b"junk\r\n\r\n"))


def test_assembly_in_any_direction(spark):
    names = ["record_type", "record_id", "refers_to", "page_id", "concurrent_to", "payload_bytes", "payload_digest", "stated_digest"]
    table = [
        ("response", "r1", None, "1", ["q1"], 5, "d1", None), ("request", "q1", None, None, [], 1, "", None), ("metadata", "m1", None, None, ["q1"], 1, "", None),
        ("response", "r2", None, "2", [], 6, "d2", None), ("request", "q3", None, None, ["r2"], 1, "", None), ("request", "q2", None, None, ["r2"], 1, "", None),
        ("metadata", "m2", None, None, ["r2", "q2"], 1, "", None), ("revisit", "r3", "r2", "3", [], 0, "e", "sha256:" + "a" * 64),
        ("revisit", "r4", "gone", "4", None, 0, "e", "sha256:" + "a" * 64), ("metadata", "alone", None, None, ["nothing"], 1, "", None),
        ("warcinfo", "w", None, None, [], 1, "", None),
    ]
    schema = ", ".join(f"{n} " + {"concurrent_to": "array<string>", "payload_bytes": "bigint"}.get(n, "string") for n in names)
    got = {r.response.record_id: r for r in warc.assemble(spark.createDataFrame(table, schema)).collect()}
    assert set(got) == {"r1", "r2", "r3", "r4"}
    assert got["r1"].request.record_id == "q1" and got["r1"].metadata.record_id == "m1"
    assert got["r2"].request.record_id == "q2" and got["r2"].n_request == 2 and got["r2"].n_metadata == 1
    assert got["r3"].response.payload_bytes == 6 and got["r3"].response.payload_digest == "d2" and got["r3"].refers_to_page == "2" and got["r3"].request is None
    assert got["r4"].response.payload_bytes is None and got["r4"].response.payload_digest == "a" * 64


def test_empty(spark, tmp_path):
    warc.write(warc.records(spark.createDataFrame([], SCHEMA)), str(tmp_path / "w"))
    assert warc.assemble(warc.read(spark, str(tmp_path / "w"))).collect() == []
