import os
import subprocess
import sys


def test_a_library_that_they_lack_is_told():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    broken = "import sys; sys.modules['xxhash'] = None; import __spark_entry__"
    assert subprocess.run([sys.executable, "-c", broken], cwd=root, timeout=120, env=env, capture_output=True).returncode != 0
