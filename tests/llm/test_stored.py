import os
import subprocess
import sys
from pathlib import Path

import pytest

WRITE = """
import sys
from sparkloom.llm.common import stored
from sparkloom.session import build_session

spark = build_session(master="local[2]", **{"spark.checkpoint.dir": f"file://{sys.argv[1]}/shared"})
print(stored(spark.range(0, 100, 1, 7), "numbers", **eval(sys.argv[2])).selectExpr("sum(id)").first()[0])
"""


@pytest.mark.parametrize(("how", "files"), [({}, 7), ({"gather": True}, 1)])
def test_processes_for_a_table(tmp_path, how, files):
    """A process that an executor starts to set permissions counts as a copy of the executor for an instant: there is
    one for a task's folder and one for its file, and none for checksums. Few rows of many tasks need one file."""
    (tmp_path / "bin").mkdir()
    chmod = tmp_path / "bin" / "chmod"
    chmod.write_text(f'#!/bin/sh\necho "$@" >> {tmp_path}/calls\n')
    chmod.chmod(0o755)
    env = os.environ | {"PATH": f"{tmp_path}/bin:{os.environ['PATH']}", "PYTHONPATH": str(Path(__file__).parents[2])}
    ran = subprocess.run([sys.executable, "-c", WRITE, str(tmp_path), repr(how)], env=env, capture_output=True, text=True, timeout=300)
    assert ran.stdout.split() == ["4950"], ran.stderr[-2000:]
    assert len(list(tmp_path.glob("shared/*/part-*"))) == files
    calls = [c for c in (tmp_path / "calls").read_text().splitlines() if "attempt_" in c]
    assert len(calls) == 2 * files, calls


COUNT = """
import sys
from sparkloom.llm.token_counts import op3_token_counts
from sparkloom.session import build_session

spark = build_session(master="local[2]", **{"spark.checkpoint.dir": f"file://{sys.argv[1]}/shared"})
rows = op3_token_counts(spark.createDataFrame([(1, "one two"), (1, "one two"), (2, None)], "doc_id long, text string")).collect()
print(sorted(r["n_pretokens"] for r in rows))
"""


def test_no_processes_for_token_counts(tmp_path):
    """Workers write the tables of op3_token_counts, so that no executor counts twice while it starts a process."""
    (tmp_path / "bin").mkdir()
    chmod = tmp_path / "bin" / "chmod"
    chmod.write_text(f'#!/bin/sh\necho "$@" >> {tmp_path}/calls\n')
    chmod.chmod(0o755)
    env = os.environ | {"PATH": f"{tmp_path}/bin:{os.environ['PATH']}", "PYTHONPATH": os.pathsep.join([str(Path(__file__).parents[2]), os.environ.get("PYTHONPATH", "")])}
    ran = subprocess.run([sys.executable, "-c", COUNT, str(tmp_path)], env=env, capture_output=True, text=True, timeout=300)
    assert ran.stdout.strip() == "[0, 2, 2]", ran.stderr[-2000:]
    assert len(list(tmp_path.glob("shared/*/part-*"))) >= 3 and not list(tmp_path.glob("shared/*/.part-*"))
    calls = [c for c in (tmp_path / "calls").read_text().splitlines() if "sparkloom-" in c]
    assert not calls, calls
