"""Member names before a value, whatever stands before them."""

import pyarrow as pa
import pytest

from terrasheaf.sources.json_splits import _key_before


@pytest.mark.parametrize("pad", [0, 1, 200, 255, 256, 257, 1000, 5000])
@pytest.mark.parametrize(("text", "want"), [('"features":', b"features"), ('"features" \n : \t', b"features"), ('"a\\"features":', b'a\\"features'), ('"x\\\\":', b"x\\\\"), ("[1, 2, ", b""), ('"features", ', b""), ('"":', b"")])
def test_key_before(pad, text, want):
    for filler in (b" ", b"\\", b'"'):
        raw = filler * pad + b"," + text.encode()
        assert _key_before(pa.BufferReader(raw + b"["), len(raw)) == want


def test_long_keys():
    raw = b"{" + b'"' + b"k" * 3000 + b'"' + b" " * 700 + b":" + b"\n" * 900
    assert _key_before(pa.BufferReader(raw + b"["), len(raw)) == b"k" * 3000
    assert _key_before(pa.BufferReader(b"   ["), 3) == b"" and _key_before(pa.BufferReader(b"["), 0) == b""
