import base64
import glob
import gzip
import hashlib
import random

from tallygrid.llm import warc
from tallygrid.session import new_work_dir

SCHEMA = "page_id long, url string, html string, path string, digest string"


def pages(count=60, seed=1):
    rng = random.Random(seed)
    bodies = ["x" * 999, "y" * 1000, "é" * 500, None, "", "WARC/1.1\r\n" * 150, "\x1f\x8b\x08" * 400]
    rows = [(i, f"http://e.com/{i} a\r\nb" if i % 5 else None, rng.choice([*bodies, f"<p>{i}</p>" * 200]), "p", "d") for i in range(count)]
    return rows + [(None, "u", "y" * 1000, None, None), (7, "again", "y" * 1000, None, None), (7, "again", "y" * 1000, None, None)]


def expected(rows):
    holder = {}
    for page, _, html, *_ in rows:
        payload = (html or "").encode()
        if len(payload) >= 1000 and page is not None:
            holder[payload] = max(page, holder.get(payload, page))
    found = []
    for page, _, html, *_ in rows:
        payload = (html or "").encode()
        revisit = payload in holder and holder[payload] != page
        found.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", holder[payload] if revisit else None))
    return sorted(found, key=str)


def test_round_trip(spark):
    rows = pages()
    found = warc.page_digests(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(map(tuple, found.collect()), key=str) == expected(rows)


def test_no_pages(spark):
    assert warc.page_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def records(count):
    return [warc.record(i, f"http://e.com/{i}", payload, hashlib.sha1(payload).hexdigest(), None) for i, payload in ((i, random.Random(i).randbytes(3000 + i)) for i in range(count))]


def read(spark, folder, content):
    path = f"{folder}/archive.warc"
    with open(path, "wb") as out:
        out.write(content)
    found = warc.read_archives(spark.createDataFrame([(path,)], "path string")).collect()
    good = sorted(r["page_id"] for r in found if r["problem"] is None)
    gaps = sorted((r["start"], r["end"]) for r in found if r["problem"] is not None)
    covered = sorted((r["start"], r["end"]) for r in found)
    assert all(a[1] == b[0] for a, b in zip(covered, covered[1:])) and (not covered or (covered[0][0], covered[-1][1]) == (0, len(content)))
    return good, gaps


def test_salvage_of_damaged_archives(spark, tmp_path):
    plain = records(6)
    for number, parts in enumerate((plain, [gzip.compress(r) for r in plain])):
        folder = tmp_path / str(number)
        folder.mkdir()
        ends = [sum(map(len, parts[: i + 1])) for i in range(6)]
        whole = b"".join(parts)
        assert read(spark, folder, whole) == ([0, 1, 2, 3, 4, 5], [])
        flipped = bytearray(whole)
        flipped[ends[1] + len(parts[2]) // 2] ^= 0xFF
        assert read(spark, folder, bytes(flipped)) == ([0, 1, 3, 4, 5], [(ends[1], ends[2])])
        junk = b"junk\x1f\x8b\x08 more junk WARC/1.1\r\nnothing\r\n\r\n"
        assert read(spark, folder, parts[0] + junk + b"".join(parts[1:])) == ([0, 1, 2, 3, 4, 5], [(ends[0], ends[0] + len(junk))])
        assert read(spark, folder, whole[: ends[4] - 10]) == ([0, 1, 2, 3], [(ends[3], ends[4] - 10)])
        assert read(spark, folder, whole[ends[0] - 20 :])[0] == [1, 2, 3, 4, 5]
        assert read(spark, folder, b"") == ([], [])


def test_archives_are_gzip_members_of_records(spark):
    folder = new_work_dir(spark, "pages")
    manifest = warc.write_pages(spark.createDataFrame(pages(5), SCHEMA), folder).collect()
    assert sum(r["records"] for r in manifest) == 8
    for path in glob.glob(f"{folder}/archives/*.warc.gz"):
        with gzip.open(path) as archive:
            assert archive.read().startswith(b"WARC/1.1\r\n")


def labelled(i, payload, block_digest, payload_digest, extra=""):
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\n{extra}"
    head += f"WARC-Block-Digest: {block_digest}\r\nWARC-Payload-Digest: {payload_digest}\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def test_digests_in_any_usual_form_are_compared(spark, tmp_path):
    payload = b"some payload" * 50
    sha1, sha256 = hashlib.sha1(payload), hashlib.sha256(payload)
    base32 = base64.b32encode(sha1.digest()).decode()
    forms = [f"sha1:{base32}", f"sha1:{base32.lower()}", f"SHA1:{sha1.hexdigest().upper()}", f"sha-256:{sha256.hexdigest()}", f"sha256:{base64.b32encode(sha256.digest()).decode().rstrip('=')}", "blake3:unknown", "sha1:not a digest"]
    content = b"".join(labelled(i, payload, form, form) for i, form in enumerate(forms))
    assert read(spark, tmp_path, content) == (list(range(len(forms))), [])
    wrong = base64.b32encode(hashlib.sha1(b"other").digest()).decode()
    bad = labelled(50, payload, f"sha1:{wrong}", f"sha1:{base32}") + labelled(51, payload, f"sha1:{base32}", f"sha1:{wrong.lower()}")
    assert read(spark, tmp_path, bad + content) == (list(range(len(forms))), [(0, len(bad))])


def test_many_records_in_a_member_and_long_headers(spark, tmp_path):
    parts = records(5)
    long = labelled(9, b"x", "other:1", "other:1", "X-Long: " + "y" * 200_000 + "\r\n")
    assert read(spark, tmp_path, gzip.compress(b"".join(parts))) == ([0, 1, 2, 3, 4], [])
    assert read(spark, tmp_path, gzip.compress(parts[0] + long) + gzip.compress(parts[1]) + long) == ([0, 1, 9, 9], [])
    big = [warc.record(i, None, random.Random(i).randbytes(400_000), "?", None) for i in range(4)]
    packed = gzip.compress(b"".join(big))
    good, gaps = read(spark, tmp_path, packed[: len(packed) * 3 // 5] + gzip.compress(parts[4]))
    assert good[:2] == [0, 1] and good[-1] == 4 and 3 not in good and gaps
    broken = bytearray(gzip.compress(parts[0]))
    broken[-6] ^= 1  # the member's own checksum
    assert read(spark, tmp_path, bytes(broken) + gzip.compress(parts[1])) == ([1], [(0, len(broken))])
