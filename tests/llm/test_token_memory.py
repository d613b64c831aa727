"""Memory of the word encoder, in a process of its own."""

import json
import os
import subprocess
import sys
from pathlib import Path

CHILD = """
import json, resource
import numpy as np, pyarrow as pa
from terrasheaf.llm import tokens

coder, plain = tokens.WordEncoder(tokens.default_vocabulary()), tokens.WordEncoder(tokens.default_vocabulary())
plain.encode(pa.array(["a first word"]))
rng = np.random.default_rng(5)
words = ["".join(map(chr, x)) for x in rng.integers(97, 123, (300_000, 8))]
texts = pa.array([" ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)] + [None])
del words
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
ids, counts = coder.encode(texts)
grown = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before
want = sum((plain.tokenizer.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()[:20]), [])
again = coder.encode(texts)[0]
print(json.dumps({"mb": grown / 1024, "same": ids[: counts[:20].sum()].tolist() == want and counts[-1] == 0 and again.tolist() == ids.tolist()}))
"""


def test_encoder_memory():
    """300,000 distinct words, 2.7 MB: their encodings are not held together."""
    root = str(Path(__file__).resolve().parent.parent.parent)
    env = os.environ | {"PYTHONPATH": root + os.pathsep + os.environ.get("PYTHONPATH", "")}
    out = json.loads(subprocess.run([sys.executable, "-c", CHILD], capture_output=True, text=True, check=True, env=env).stdout.splitlines()[-1])
    assert out["same"] and out["mb"] < 130, out
