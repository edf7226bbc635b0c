"""Each test fails on a version that judged less than every candidate."""

import numpy as np

from treeloom.llm import secrets

TOKEN = "x9Kf2LqPz7RvT4mWb8YcN3dH"


def found(texts):
    data = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(d) for d in data])).astype(np.int64)
    return secrets.scan(secrets.trained(), np.frombuffer(b"".join(data), np.uint8), offsets)["secrets"].to_pylist()


def test_secrets_behind_long_prefixes_and_beside_base_matches():
    path = "see https://hooks.example.com/services/T00000000/B00000000/" + TOKEN
    deep = "/".join(["usr", "share", "documents", "archive2", "reports", "quarterly", "figures"]) + "/" + TOKEN
    hexed = "0123456789abcdef01234567/" + TOKEN
    got = found([path, deep, hexed])
    for text, spans in zip((path, deep, hexed), got):
        assert any(s["kind"] == "model" and s["end"] == len(text) for s in spans)
    assert [s["kind"] for s in got[2]] == ["hex", "model"] and got[2][0]["score"] != 1.0


def test_windows_cover_a_candidate_and_parts_leave_base_spans_out():
    for end in (16, 48, 49, 64, 65, 200):
        at = secrets.starts(0, end)
        assert set(range(end)) == {j for a in at for j in range(a, min(end, a + secrets.INSIDE))}
    assert secrets.outside(0, 50, [(10, 20), (15, 30), (45, 60)]) == [(0, 10), (30, 45)]
