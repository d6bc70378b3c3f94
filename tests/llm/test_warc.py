import hashlib
import struct

import pyarrow.fs
import zstandard

from panelwatch.llm import warc


def test_round_trip(spark):
    page = "<html>" + "shared header and body of a page " * 20
    rows = [(i, f"http://x/{i}", page + str(i % 7)) for i in range(200)] + [(900, None, None), (901, "u", ""), (902, "a b", "é😀\r\n\r\nx" * 30), (903, "c", "short"), (904, "c", "short"), (None, "n", page + "0"), (905, "z" * 10, "q" * 3_000_000)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, digest int, n string").repartition(3)
    files = warc.archive(pages).collect()
    assert sum(f.records for f in files) == len(rows)
    got = warc.read_archive(spark, [f.path for f in files]).collect()
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, u, h in rows:
        data = (h or "").encode()
        to = first.get(h)
        again = to is not None and to != i
        want.append((i, u and " ".join(u.split()), "revisit" if again else "response", to if again else None, len(data), hashlib.sha256(data).hexdigest(), None if again else (h or "")))
    key = lambda r: (r[0] is not None, r[0])
    assert sorted(((r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload) for r in got), key=key) == sorted(want, key=key)


def test_every_record_is_a_frame_of_its_own_after_the_dictionary(spark):
    rows = [(i, "u", f"<p>{i}</p>" + "some words that all pages have " * 8 + str(i * i)) for i in range(300)]
    path = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).first().path
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    content = fs.open_input_stream(name, compression=None).read()
    magic, n = struct.unpack_from("<II", content)
    assert magic == warc.DICTIONARY_FRAME and n > 0
    records = list(warc.frames(content))
    assert len(records) == 301 and all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in records)
    plain = sum(len(zstandard.compress(r)) for r in records)
    assert len(content) - n < 0.6 * plain


def test_odd_rows(spark):
    schema = "page_id long, url string, html string"
    assert warc.archive(spark.createDataFrame([], schema)).count() == 0
    assert warc.read_archive(spark, []).count() == 0
    copies = spark.createDataFrame([(3, "a", "y" * 100)] * 2 + [(2, "b", "y" * 99)] * 2, schema)
    got = sorted((r.page_id, r.record_type) for r in warc.read_archive(spark, [f.path for f in warc.archive(copies).collect()]).collect())
    assert got == [(2, "response"), (2, "response"), (3, "response"), (3, "response")]
