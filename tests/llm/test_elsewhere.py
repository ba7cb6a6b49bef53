"""Every operator and the pipeline in a process that works in another folder, where workers cannot import the package."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import random, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "shared").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
r = random.Random(1)
text = lambda n: " ".join(r.choice(["the", "of", "and", "to", "in", "that", "harbour", "winter", "letter", "morning", "river"]) + r.choice(["", "", "s", "ly", "er"]) for _ in range(n))
docs = [(i, text(120), r.choice(["en", None]), r.choice("ab"), 9) for i in range(40)]
docs += [(100 + i, docs[i][1], "en", "a", 9) for i in range(5)] + [(200, None, None, None, None), (201, "", "en", "b", 0)]
write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet("tables/" + name + ".parquet")
write("documents", docs, "doc_id long, text string, lang string, source string, n_chars long")
write("labels", [(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
write("benchmark", [(1, " ".join(docs[3][1].split()[20:40]))], "item_id long, text string")
write("pages", [(1, "u", "<article><p>" + text(40) + "</p></article>"), (2, "v", None)], "page_id long, url string, html string")
import __spark_entry__ as entry
for name, query in entry.queries().items():
    if name.startswith("op") or name == "pipeline":
        print("rows", name, len(query(spark, "tables").collect()))
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    rows = {line.split()[1]: int(line.split()[2]) for line in said.stdout.splitlines() if line.startswith("rows ")}
    assert len(rows) == 14, said.stderr[-3000:]
    # Pages, phrases (none is frequent) and orders by steps of two languages have rows of their own number.
    other = {"op5_html_text": 2, "op12_collocations": 0, "op13_filter_audit": 1200}
    assert all(n == other.get(name, 47) for name, n in rows.items() if name != "pipeline") and rows["pipeline"] >= 0
