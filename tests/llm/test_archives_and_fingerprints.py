"""Operators 4 and 6."""

import base64
import base64
import hashlib
import io
import random
import zipfile
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tideline.llm import multiset_hash, zip_warc
from tideline.llm.common import new_path
from tideline.llm.multiset_hash import Fingerprint, paragraphs


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


ROWS = [(i, f"http://x/{i}", f"<p>{i % 4}</p>" if i < 20 else prose(i, 50)) for i in range(30)] + [
    (40, None, None), (41, "http://y\r\nx: 1", ""), (None, "http://z", "<p>1</p>"), (None, "http://z", "only nulls"), (None, "http://z", "only nulls"), (50, "u", "twin"), (50, "u", "twin"), (51, "é ü", "größe \r\n\r\n WARC/1.1"),
]


def expected(rows, least=0):
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        ids = [x for x in groups[b] if x is not None]
        best = max(ids) if ids and len(groups[b]) > 1 and len(b) >= least else None
        refers = best if best is not None and i != best else None
        out.append((i, len(b), sha(b), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("payload_bytes", F.lit(1)).repartition(3)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in zip_warc.round_trip(pages, least).collect()]
    assert sorted(got, key=repr) == expected(ROWS, least)
    assert zip_warc.round_trip(pages.limit(0)).count() == 0


def test_hot_payloads_and_payloads_themselves(spark, monkeypatch):
    rows = [(i, f"u{i}", "same" if i % 3 else f"own {i}") for i in range(3500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    monkeypatch.setattr(zip_warc, "ARCHIVE_BYTES", 20_000)
    archives = zip_warc.write_archives(pages, new_path(spark, "t"))
    assert archives.count() > 4
    got = {r.page_id: (bytes(r.payload) if r.payload is not None else None, r.refers_to) for r in zip_warc.read_records(zip_warc.locate(archives, 4_000)).collect()}
    assert len(got) == 3500 and got[3] == (b"own 3", None) and got[1] == (None, 3499) and got[3499] == (b"same", None)


@pytest.mark.parametrize("limit", [1 << 31, 10])
def test_zip_directories(monkeypatch, limit):
    """limit=10: every size, offset and count takes the ZIP64 form."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
    if limit == 10:
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", b"stored bytes " * 3)
        z.writestr(zipfile.ZipInfo("b/ü.bin"), bytes(range(200)))
        z.writestr("packed", b"x" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    data = out.getvalue()
    found = zip_warc.zip_members(io.BytesIO(data), len(data))
    assert set(found) == {"a.txt", "b/ü.bin"}  # only stored members can be read by range
    for name, want in (("a.txt", b"stored bytes " * 3), ("b/ü.bin", bytes(range(200)))):
        at, n = found[name]
        assert data[at : at + n] == want
    with pytest.raises(ValueError, match="central directory"):
        zip_warc.zip_members(io.BytesIO(b"no zip"), 6)


def test_archives_are_plain_zip_and_warc(spark):
    pages = spark.createDataFrame(ROWS[:5], "page_id long, url string, html string").coalesce(1)
    [a] = zip_warc.write_archives(pages, new_path(spark, "t")).collect()
    with zipfile.ZipFile(a.path.removeprefix("file:")) as z:
        assert z.testzip() is None and set(z.namelist()) == {zip_warc.MEMBER, zip_warc.INDEX, zip_warc.PACKAGE}
        assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
        import gzip

        assert gzip.decompress(z.read(zip_warc.MEMBER)).count(b"WARC/1.1\r\n") == 5


def test_broken_payload_is_noticed():
    record = zip_warc.warc_record(1, "u", b"payload", None)
    assert zip_warc.parse_record(record)["payload"] == b"payload"
    with pytest.raises(ValueError, match="headers"):
        zip_warc.parse_record(record.replace(b"payload\r\n", b"payl0ad\r\n"))


def brute_print(text):
    """Lanes and signs added up one by one in plain Python, and the fingerprint's text form."""
    lanes, signs = [0] * 64, [0] * 128
    for p in text.split("\n"):
        if p:
            raw = hashlib.shake_128(p.encode()).digest(256)
            lanes = [(x + int.from_bytes(raw[4 * i : 4 * i + 4], "little")) % 2**32 for i, x in enumerate(lanes)]
            for run in multiset_hash.runs(p):
                raw = hashlib.blake2b(run.encode(), digest_size=16).digest()
                signs = [x + (1 if raw[i // 8] >> (7 - i % 8) & 1 else -1) for i, x in enumerate(signs)]
    packed = b"".join(x.to_bytes(4, "little") for x in lanes) + b"".join((x % 2**32).to_bytes(4, "little") for x in signs)
    return base64.b64encode(packed).decode(), lanes, signs


def brute_likeness(a, b):
    if a[1] == b[1]:
        return 1.0
    dot, size = sum(x * y for x, y in zip(a[2], b[2], strict=True)), (sum(x * x for x in a[2]) * sum(x * x for x in b[2])) ** 0.5
    return round(min(0.999, max(0.0, dot / size)), 9) if size else 0.0


def brute_edits(rows):
    """rows in order."""
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        own, new, following = brute_print(t), brute_print(edited), brute_print(after)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), own[0], new[0], brute_likeness(own, new), brute_likeness(own, following)))
    return out


def check_against_brute_force(df):
    order = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).orderBy(F.col("doc_id").asc_nulls_first(), "h", "text")
    rows = [(r.doc_id, r.text) for r in order.collect()]
    got = [(*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in multiset_hash.compared_with_next(df).collect()]
    assert sorted(got, key=repr) == sorted(brute_edits(rows), key=repr)


def test_fingerprints_of_odd_rows(odd, empty):
    check_against_brute_force(odd)
    check_against_brute_force(odd.filter("doc_id = 10"))
    assert multiset_hash.compared_with_next(empty).count() == 0


def test_small_batches(spark, monkeypatch, sf):
    monkeypatch.setattr(multiset_hash, "BATCH_CHARS", 3000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check_against_brute_force(docs)
    r = multiset_hash.compared_with_next(docs).agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n"), F.avg((F.col("near_edited") > F.col("near_next")).cast("int")).alias("more")).first()
    assert r.e > 0.65 and r.n < 0.1 and r.more > 0.97


def test_likeness_of_very_repetitive_texts(spark):
    line, other = "the same sentence again and again", "words that stand in no other line"
    counts = [(1, 70_000), (2, 40_000), (3, 65_536)]
    rows = [(i, "\n".join([line] * n)) for i, n in counts] + [(4, "\n".join([other] * 70_000))]
    got = {r.doc_id: r for r in multiset_hash.compared_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    one = brute_print(line)
    for i, n in counts:
        packed = b"".join((x * n % 2**32).to_bytes(4, "little") for x in [*one[1], *one[2]])
        assert got[i].fingerprint == base64.b64encode(packed).decode()
    assert [got[i].near_next for i in (1, 2)] == pytest.approx([0.999, 0.999]) and got[3].near_next == pytest.approx(brute_likeness(one, brute_print(other)))
    assert got[1].near_edited >= 0.999  # its end gives way to the same line, cut elsewhere


def test_homomorphism():
    text = "\n".join(prose(s, 30) for s in range(20))
    units = paragraphs(text)
    whole = Fingerprint.of(text)
    g = random.Random(1)
    g.shuffle(units)
    assert str(Fingerprint().insert(units[:7]).insert(units[7:])) == str(whole)
    assert str(whole.insert(["new one"]).delete(["new one"])) == str(whole)
    assert str(whole.delete(units)) == str(Fingerprint()) == str(Fingerprint.of(None))
    assert str(Fingerprint.parse(str(whole))) == str(whole) and whole.likeness(whole) == 1.0
    assert str(Fingerprint.of(text + "\nmore words here")) != str(whole)
    assert Fingerprint().likeness(whole) == 0.0


def test_paragraph_cuts_survive_edits():
    long = prose(1, 400).replace(".", "")
    a, b = multiset_hash.runs(long), multiset_hash.runs("a few other words " + long)
    assert len(set(a) & set(b)) > 0.6 * len(set(a))


def test_paragraphs_are_told_apart():
    for a, b in (("a b c d e f g h", "a b c d\ne f g h"), ("x y. z", "x y\nz")):
        assert str(Fingerprint.of(a)) != str(Fingerprint.of(b)) and Fingerprint.of(a).likeness(Fingerprint.of(b)) < 1.0
