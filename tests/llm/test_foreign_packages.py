"""Packages of other tools, and reading by the runs of an index."""

import gzip
import json
import zipfile

from vecskein.llm import warc


def test_several_archives_and_keyed_lines(tmp_path):
    records = [warc.record(k, f"u{k}", b"p%d" % k * 50, warc.sha1_base32(b"p%d" % k * 50), "response", None) for k in range(6)]
    path, lines = tmp_path / "other.wacz", []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for name, part in (("a.warc.gz", records[:3]), ("b.warc", records[3:])):
            data = b""
            for r in part:
                packed = gzip.compress(r) if name.endswith("gz") else r
                lines.append(f"com,example)/{len(lines)} 2020 " + json.dumps({"offset": str(len(data)), "length": str(len(packed)), "filename": name}))
                data += packed
            z.writestr(f"archive/{name}", data)
        z.writestr("indexes/index.cdxj", "\n".join(lines))
        z.writestr("pages/pages.jsonl", "{}")
    found = [raw for _, raw in warc.read_records(str(path))]
    assert found == records and [warc.parse_record(r)["payload"] for r in found] == [b"p%d" % k * 50 for k in range(6)]


def test_headers_without_blanks():
    raw = warc.record(1, "u", b"body", warc.sha1_base32(b"body"), "response", None)
    for old, new in ((b"WARC-Type: ", b"WARC-Type:"), (b"Content-Type: text", b"content-type:text")):
        raw = raw.replace(old, new)
    size = len(raw.partition(b"\r\n\r\n")[2]) - 4
    raw = raw.replace(f"Content-Length: {size + 1}".encode(), f"Content-Length: {size}".encode())
    got = warc.parse_record(raw)
    assert got["payload"] == b"body" and got["fields"]["warc-type"] == "response" and got["http"]["content-type"].startswith("text/html")


def test_runs_name_their_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RUN_RECORDS", 4)
    pack = warc.PackageWriter(str(tmp_path / "p.zip"))
    for k in range(10):
        pack.add(k, warc.record(k, "é", b"x" * k, warc.sha1_base32(b"x" * k), "response", None))
    runs = pack.close()
    assert len(runs) == 3
    assert [[i for i, _ in warc.read_records(pack.path, r)] for r in runs] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
