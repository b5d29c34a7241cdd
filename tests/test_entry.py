import re
import subprocess

import __spark_entry__


def test_queries_and_sql_agree_on_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_only_the_entry_guards_the_training_data_operators():
    files = subprocess.run(["git", "ls-files", "veilspark"], capture_output=True, text=True, cwd=__spark_entry__.ROOT).stdout.split()
    for f in files:
        if not f.startswith("veilspark/llm/"):
            assert not re.search(r"\bllm\b", open(f"{__spark_entry__.ROOT}/{f}").read()), f
