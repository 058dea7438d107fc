"""Salvage inside a gzip member that holds several records."""

from __future__ import annotations

import hashlib
import io
import random
import zlib

import pyarrow as pa
import pytest

from tracewright.llm import warc


def made(k):
    rng = random.Random(k)
    body = bytes(rng.randrange(32, 127) for _ in range(3000))
    return warc.record(k, f"http://{k}", body, hashlib.sha256(body).hexdigest(), None)


def salvaged(data):
    return [None if x["gap"] else x["page_id"] for x in warc.salvage(pa.PythonFile(io.BytesIO(data), "r"))]


@pytest.mark.parametrize("level", [0, 6])
def test_good_records_of_a_damaged_member_stay(level):
    def member(data):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        return z.compress(data) + z.flush()

    parts = [made(k) for k in range(6)]
    bad = [*parts[:2], parts[2][:900] + b"????" + parts[2][904:], *parts[3:]]
    after = member(made(9))
    assert salvaged(member(b"".join(parts)) + after) == [0, 1, 2, 3, 4, 5, 9]
    assert salvaged(member(b"".join(bad)) + after) == [0, 1, None, 3, 4, 5, 9]
    whole = member(b"".join(parts))
    assert salvaged(whole[:-8] + b"\0\0\0\0" + whole[-4:] + after) == [0, 1, 2, 3, 4, 5, None, 9]  # bad CRC
    cut = salvaged(whole[: len(whole) // 2])  # cut tail
    assert cut[:2] == [0, 1] and cut[-1] is None and len(cut) in (3, 4)
    both = salvaged(whole[: len(whole) // 2] + after)
    assert both[:2] == [0, 1] and both.count(9) == 1 and None in both
