from __future__ import annotations

import hashlib
import zipfile
import zlib

import pytest

from proofset.llm import archive_source as source
from proofset.llm import media as op


@pytest.mark.parametrize("text", [b"", b"x", b"y" * 64, b"z" * 65, bytes(range(256)) * 40])
def test_round_trip(text):
    samples = op.payload(text)
    assert len(samples) % 64 == 0 and len(samples) >= 64 and samples.rstrip(b"\0") == text.rstrip(b"\0")
    assert op.decode(op.encode(samples, len(text))) == (samples, len(text))
    assert op.feature(samples) == op.feature(bytes(samples))


def test_damage_is_noticed():
    image = bytearray(op.encode(op.payload(b"hello"), 5))
    image[-20] ^= 1
    with pytest.raises(ValueError):
        op.decode(bytes(image))


def test_columns(spark, frame, odd_rows):
    got = op.media_columns(frame(odd_rows).repartition(3)).collect()
    want = []
    for i, text in odd_rows:
        data = (text or "").encode()
        p = op.payload(data)
        want.append((i, len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted(((r.id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=str) == sorted(want, key=str)
    by_text = {}
    for r in got:
        by_text.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for k, v in by_text.items())
    assert op.media_columns(frame([])).count() == 0


def test_ranges_share_out_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(50):
            z.writestr(zipfile.ZipInfo(f"{i}"), bytes([i]) * (100 + 37 * i))
    (tmp_path / ".half.zip-1").write_bytes(b"junk")
    reader = source.ArchiveReader({"path": f"file://{tmp_path}", "splitbytes": "1000", "batchbytes": "500"})
    ranges = reader.partitions()
    rows = [r for part in ranges for b in reader.read(part) for r in b.to_pylist()]
    assert len(ranges) > 40 and sorted(int(r["member"]) for r in rows) == list(range(50))
    assert all(r["payload"] == bytes([int(r["member"])]) * (100 + 37 * int(r["member"])) for r in rows)


class Flaky:
    """A store whose first reads fail or come back damaged."""

    def __init__(self, store, failures):
        self.store, self.failures, self.opened = store, failures, 0

    def open_input_file(self, path):
        self.opened += 1
        if self.opened <= self.failures:
            raise OSError("lost")
        return self.store.open_input_file(path)


def test_members_are_retried_by_themselves(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr(zipfile.ZipInfo("m"), b"payload")
    store, path = source.open_store(f"file://{tmp_path}")
    flaky = Flaky(store, 2)
    assert source.read_member(flaky, f"{path}/a.zip", 0, 7, zlib.crc32(b"payload"), 4, 0) == b"payload" and flaky.opened == 3
    with pytest.raises(OSError):
        source.read_member(Flaky(store, 9), f"{path}/a.zip", 0, 7, zlib.crc32(b"payload"), 3, 0)
    with pytest.raises(OSError):
        source.read_member(store, f"{path}/a.zip", 0, 7, 1, 2, 0)


def test_archives_roll_over(spark, frame, tmp_path, prose):
    uri = f"file://{tmp_path}/archives"
    done = op.write_archives(frame([(i, prose(i, 300)) for i in range(40)]).repartition(2), uri, archive_bytes=5000).collect()
    assert len(done) > 4 and sum(r.members for r in done) == 40 and op.read_archives(spark, uri, splitBytes="2000").count() == 40


def test_only_the_manifest_counts(spark, frame, tmp_path, prose):
    """Archives that a lost or repeated attempt left in the folder are not read."""
    uri = f"file://{tmp_path}/archives"
    done = op.write_archives(frame([(i, prose(i, 30)) for i in range(20)]).repartition(2), uri).collect()
    stale = tmp_path / "archives" / "part-000000-999-00000.zip"
    stale.write_bytes(open(done[0].archive, "rb").read())
    assert [r.size for r in done] == [source.open_store(uri)[0].get_file_info(r.archive).size for r in done]
    got = [r.id for r in op.features(op.read_archives(spark, uri)).collect()]
    assert sorted(got) == list(range(20))


def plain_feature(samples):
    lines = [samples[i : i + 64] for i in range(0, len(samples), 64)]
    n, values = len(lines), list(samples)
    mean = sum(values) / len(values)
    edges = [k * n // 8 for k in range(8)] + [n]
    grid = []
    for k in range(8):
        band = lines[edges[k] : edges[k + 1]] if n >= 8 else lines
        for c in range(8):
            cell = [v for line in band for v in line[8 * c : 8 * c + 8]]
            grid.append(sum(cell) / len(cell))
    bits = "".join("1" if g > sum(grid) / 64 else "0" for g in grid)
    deviation = (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5
    return f"h{n} mean{mean:.3f} dev{deviation:.3f} hash{int(bits, 2):016x}"


@pytest.mark.parametrize("n", [0, 1, 64, 100, 511, 513, 5000])
def test_feature_against_brute_force(n, prose):
    samples = op.payload(prose(n, n).encode()[:n])
    assert op.feature(samples) == plain_feature(samples)
