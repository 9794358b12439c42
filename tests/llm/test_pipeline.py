"""The whole pipeline on a small corpus with planted cases, stage by stage decided by plain means, and on odd tables."""
import random

import corpus_pipeline
import public_tokenizers
import tiktoken

from pixelloom.llm import bpe

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def run(spark, tmp_path, rows):
    path = str(tmp_path / "corpus")
    spark.createDataFrame([(d, t, lang, s, len(t or "")) for d, t, lang, s in rows], KIND).write.parquet(f"{path}/documents.parquet")
    return corpus_pipeline.run(spark, path).collect()


def test_planted_cases(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = {d: prose(150 + d % 60) for d in range(120)}
    passage = prose(60)
    texts |= {200: passage + " " + prose(100), 201: prose(90) + " " + passage, 210: texts[3], 211: texts[4].upper(), 212: " ".join(texts[5].split()[:-3]) + " other end here"}
    texts |= {220: "too short", 221: " ".join("ab#$%" for _ in range(100)), 222: None, 223: ""}
    rows = [(d, t, "en", f"s{d % 3}") for d, t in texts.items()]
    out = run(spark, tmp_path, rows)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {d: texts[d] for d in texts if d < 210} | {201: " ".join(texts[201].split()[:90])}
    # Every row that is left is a document that passes, with its passage cut, as often as the mix took it.
    assert {r["doc_id"] for r in out} <= set(want)
    copies = {d: sum(r["doc_id"] == d for r in out) for d in want}
    assert all(r["ids"] == enc.encode_ordinary(want[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) for r in out) and max(copies.values()) <= 2
    size = {d: len(t.split()) for d, t in want.items()}
    for s, weight in ((0, 5), (1, 2), (2, 1)):
        have = sum(size[d] for d in want if d % 3 == s)
        taken = sum(size[d] * copies[d] for d in want if d % 3 == s)
        assert taken <= 2 * have and (s or abs(taken - 2 * have) <= 300)  # the heaviest source stops at twice its size
    total = sum(size.values())
    assert abs(sum(size[d] * n for d, n in copies.items()) - 1.5 * total) <= 900


def test_odd_tables(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
    text = " ".join(f"word{k}" for k in range(80))
    (tmp_path / "two").mkdir()
    out = run(spark, tmp_path / "two", [(None, text, None, None), (None, None, None, None), (7, text + " more", None, "s"), (7, text + " more", None, "s")])
    assert {r["doc_id"] for r in out} <= {None, 7}
