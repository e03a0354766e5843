import subprocess
import sys

import pytest

CODE = """
import sys
if sys.argv[1]:
    sys.modules[sys.argv[1]] = None  # any import of it fails
import __spark_entry__ as e
q, sql = e.queries(), e.oracle_sql()
assert set(sql) <= set(q)
print(len([k for k in q if not k.startswith("op") and k != "pipeline"]), len(q))
"""


@pytest.mark.parametrize("hidden", ["", "xxhash", "tiktoken", "sentencepiece", "public_tokenizers", "litlens.llm", "corpus_pipeline"])
def test_other_queries_load_without_what_llm_needs(hidden):
    import os
    out = subprocess.run([sys.executable, "-c", CODE, hidden], capture_output=True, text=True,
                         cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert out.returncode == 0, out.stderr
    own, everything = map(int, out.stdout.split())
    assert own == 60 and (hidden in ("", "corpus_pipeline") or everything == own)
