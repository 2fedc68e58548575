import gzip
import hashlib
import random

import pytest

from channelgraph.llm import warc
from channelgraph.llm.warc import Record, member, read_archives, record_bytes, salvage, with_revisits, write_archives

LONG = "<p>" + "x" * 200


def record(i, payload=None):
    body = payload if payload is not None else f"page {i} ".encode() * 40
    return record_bytes(i, f"http://h/{i}", body, hashlib.sha256(body).hexdigest(), False, None)


def found(data):
    return [int(r.headers["x-page-id"]) for _, _, r in salvage(data) if isinstance(r, Record)]


def gaps(data):
    return [(a, b) for a, b, r in salvage(data) if isinstance(r, str)]


@pytest.mark.parametrize("pack", [member, lambda r: r])
def test_whole_files(pack):
    parts = [pack(record(i)) for i in range(50)] + [pack(record(50, b"")), pack(record(51, b"\r\n\r\nWARC/1.1\r\n\x1f\x8b\x08"))]
    assert found(b"".join(parts)) == list(range(52)) and gaps(b"".join(parts)) == []
    assert list(salvage(b"")) == []


@pytest.mark.parametrize("pack", [member, lambda r: r])
def test_damage_costs_the_damaged_records_only(pack):
    draw = random.Random(1)
    parts = [pack(record(i)) for i in range(40)]
    ends = [sum(map(len, parts[: i + 1])) for i in range(40)]
    for _ in range(60):
        data, hurt = bytearray(b"".join(parts)), set()
        for _ in range(draw.randrange(1, 4)):
            at = draw.randrange(len(data))
            hurt.add(next(i for i, e in enumerate(ends) if at < e))
            data[at] ^= draw.randrange(1, 256)
        whole = set(range(40)) - hurt
        got = found(bytes(data))
        assert whole <= set(got) and got == sorted(got)
        at = 0
        for start, end, _ in salvage(bytes(data)):  # every byte is in a record or in a gap
            assert start == at
            at = end
        assert at == len(data)


@pytest.mark.parametrize("pack", [member, lambda r: r])
def test_cut_and_foreign_bytes(pack):
    parts = [pack(record(i)) for i in range(6)]
    assert found(b"noise\x1f\x8b\x08" + b"".join(parts)) == list(range(6))
    assert found(b"".join(parts[:3]) + parts[3][:-40]) == [0, 1, 2]
    assert found(b"".join(parts[:3]) + parts[3][:50] + b"".join(parts[4:])) == [0, 1, 2, 4, 5]
    assert gaps(b"".join(parts) + b"tail") == [(sum(map(len, parts)), sum(map(len, parts)) + 4)]


def test_mixed_members_and_plain_records():
    assert found(member(record(1)) + record(2) + b"?" + member(record(3))) == [1, 2, 3]
    assert gzip.decompress(member(record(9))) == record(9)


def test_members_of_several_records():
    texts = [record(i) for i in range(12)]
    whole = member(b"".join(texts))
    assert found(whole) == list(range(12)) and gaps(whole) == []
    assert found(member(b"".join(texts[:3])) + member(texts[3]) + member(b"".join(texts[4:]))) == list(range(12))
    rows = list(salvage(member(texts[0] + texts[1]) + texts[2]))
    assert {a for a, _, _ in rows[:2]} == {0} and rows[1][1] == rows[2][0] == len(member(texts[0] + texts[1]))
    # a record that is wrong inside a sound member, and bytes after the last one
    hurt = bytearray(b"".join(texts))
    hurt[len(texts[0]) + len(texts[1]) - 20] ^= 1
    assert found(member(bytes(hurt))) == [0, *range(2, 12)] and len(gaps(member(bytes(hurt)))) == 1
    assert found(member(texts[0] + b"tail")) == [0] and len(gaps(member(texts[0] + b"tail"))) == 1
    assert found(member(b"")) == found(member(b"tail")) == []


def test_a_damaged_member_keeps_the_records_before_the_damage():
    draw = random.Random(3)
    whole = member(b"".join(record(i, draw.randbytes(900)) for i in range(30)))
    half = len(whole) // 2
    after = member(record(99))
    for data in (whole[:half], whole[:half] + after, whole[:half] + bytes([whole[half] ^ 255]) + whole[half + 1 :] + after, whole[:-8] + bytes(8) + after):
        got = [i for i in found(data) if i != 99]
        assert got == sorted(got) and got[:13] == list(range(13)) and len(gaps(data)) == 1
        assert (found(data)[-1] == 99) == data.endswith(after)
    # without a digest nothing speaks for a record of such a member
    bare = member(b"".join(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" for _ in range(3)))
    assert sum(isinstance(r, Record) for _, _, r in salvage(bare)) == 3
    assert not any(isinstance(r, Record) for _, _, r in salvage(bare[:-8] + bytes(8)))


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


ROWS = [
    (3, "http://a/", LONG), (1, "http://b/", LONG), (2, None, LONG + "é"), (4, "http://c/ d\nx", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"),
    (8, "u", "z" * 400_000), (9, "u", "z" * 400_000), (None, "n", LONG), (1, "http://b/", LONG), (10, "u", "y" * 100), (11, "v", "y" * 100), (12, "v", "w" * 99), (13, "v", "w" * 99),
]


def want(rows):
    out, groups = [], {}
    for i, _, h in rows:
        groups.setdefault((h or "").encode(), []).append(i)
    for body, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        seen = False
        for i in ids:
            again = len(body) >= 100 and (i != first or seen)
            seen |= i == first
            out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, clashing, tmp_path, compress):
    folder = f"{tmp_path}/w"
    manifest = write_archives(with_revisits(clashing(pages_of(spark, ROWS)).repartition(5)), folder, compress, roll=2000)
    rows = read_archives(spark, folder, manifest, with_payload=True).collect()
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows]
    assert all(r["gap"] is None for r in rows) and sorted(map(str, got)) == want(ROWS)
    texts = {r["page_id"]: bytes(r["payload"]).decode() for r in rows if r["record_type"] == "response"}
    assert texts[2] == LONG + "é" and texts[4] == "" and len(texts[8]) == 400_000
    assert sum(r["records"] for r in manifest.collect()) == len(ROWS)


def test_files_without_a_manifest_are_not_read(spark, tmp_path):
    folder = f"{tmp_path}/w"
    manifest = write_archives(with_revisits(pages_of(spark, ROWS[:3])), folder)
    (tmp_path / "w/files/left-over.warc.gz").write_bytes(member(record(99)))
    assert read_archives(spark, folder, manifest).count() == 3 and read_archives(spark, folder).count() == 4


def test_gaps_are_logged(spark, tmp_path):
    folder = f"{tmp_path}/w"
    write_archives(with_revisits(pages_of(spark, [(i, "u", f"{i}" * 300) for i in range(30)]).coalesce(1)), folder)
    file = next((tmp_path / "w/files").glob("*.gz"))
    data = bytearray(file.read_bytes())
    data[len(data) // 2] ^= 0xFF
    file.write_bytes(bytes(data))
    rows = read_archives(spark, folder).collect()
    assert sum(r["gap"] is None for r in rows) == 29 and sum(r["gap"] is not None for r in rows) == 1


def test_empty_table(spark, tmp_path):
    folder = f"{tmp_path}/w"
    manifest = write_archives(with_revisits(pages_of(spark, [])), folder)
    assert manifest.count() == 0 and read_archives(spark, folder, manifest).collect() == []


def test_query(spark, small):
    rows = [r for r in ROWS if r[0] is not None]
    got = warc.op9_salvage_warc(spark, small(pages=pages_of(spark, rows))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(str(tuple(r)) for r in got) == want(rows)
