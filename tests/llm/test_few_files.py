"""Scratch tables of small dealings: few tasks and files, the same result."""

import random
from pathlib import Path

from vecskein.llm import substrings
from vecskein.session import held


def test_small_dealings_take_few_files(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    passages = [word(150) for _ in range(120)]
    texts = [word(60) + rng.choice(passages) + word(60) + rng.choice(passages) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    files, wrote = [], substrings.materialize

    def counted(df, tag, *args):
        out = wrote(df, tag, *args)
        if tag == "verdicts":
            files.append(len(list(Path(out._vecskein_path.removeprefix("file:")).glob("part-*"))))
        return out

    monkeypatch.setattr(substrings, "materialize", counted)
    with held(spark, {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "true"}):
        got = {r.doc_id: r.n_removed for r in substrings.dedup(docs, hot=4).select("doc_id", "n_removed").collect()}
    assert len(files) > 1 and max(files) < 8

    seen, gone = set(), {}
    for i, t in enumerate(texts):
        cut = set()
        for a in range(len(t) - 99):
            if t[a : a + 100] in seen:
                cut.update(range(a, a + 100))
            seen.add(t[a : a + 100])
        gone[i] = len(cut)
    assert got == gone
