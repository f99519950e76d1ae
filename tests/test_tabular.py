"""Fingerprints of files longer than a range."""

import hashlib
import random

import pytest

from foldwright.operators.audit import ContractError
from foldwright.sources import tabular as T

RANGE = 1 << 16


@pytest.fixture
def short_ranges(spark):
    """No task may take a file above a range as one value; splits are shorter than a range and do not divide it."""
    settings = {"spark.sql.sources.binaryFile.maxLength": str(RANGE), "spark.sql.files.maxPartitionBytes": "30000"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield spark
    for key in settings:
        spark.conf.unset(key)


def _write(folder, files):
    for name, content in files.items():
        (folder / name).write_bytes(content)
    return {name: (len(content), hashlib.sha256(content).hexdigest()) for name, content in files.items()}


def test_long_files_are_hashed_by_ranges(short_ranges, tmp_path):
    noise, mark = random.Random(4).randbytes, b"\xef\xbb\xbf"
    files = {
        "a b%20.bin": noise(300_001), "ends.bin": noise(100_000) + b"\n", "mark.csv": mark + noise(100_000), "mark2.csv": mark + noise(100_000) + b"\n",
        "returns.txt": b"ab\r\n\r\n\n\rx" * 9000, "zero.bin": bytes(100_000), "lines.bin": b"\n" * 70_001, "[x].bin": noise(90_000), "ü.bin": noise(RANGE + 1),
        "exact.bin": noise(RANGE), "small.bin": b"abc",
    }
    expected = _write(tmp_path, files)
    rows = T.dataset_fingerprint(short_ranges, str(tmp_path), range_bytes=RANGE).collect()
    assert {r.name: (r.size, r.digest) for r in rows} == expected
    lines = "\n".join(sorted(f"{n}:{size}:{digest}" for n, (size, digest) in expected.items()))
    assert {r.fingerprint for r in rows} == {hashlib.sha256(lines.encode()).hexdigest()}


def test_packed_names_and_missing_library_keep_whole_files(spark, tmp_path, monkeypatch):
    expected = _write(tmp_path, {"x.csv.gz": random.Random(5).randbytes(90_000), "y.bin": random.Random(6).randbytes(90_000)})
    take = lambda: {r.name: (r.size, r.digest) for r in T.dataset_fingerprint(spark, str(tmp_path), range_bytes=RANGE).collect()}
    assert take() == expected
    monkeypatch.setattr(T, "sha256_steps", lambda: None)
    assert take() == expected


def test_bytes_that_the_reader_leaves_out_are_an_error(spark, tmp_path):
    _write(tmp_path, {"x.bin": random.Random(7).randbytes(90_000)})
    path = spark.read.format("binaryFile").load(str(tmp_path)).select("_metadata.file_path").first()[0]
    with pytest.raises(ContractError, match="bytes read"):
        T._digests_by_range(spark, str(tmp_path), "*", {path: 100_000}, RANGE)
