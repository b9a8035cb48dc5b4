"""Edge cases that several operators define: very long conversations, repeated vectors."""

import hashlib

import public_tokenizers as P

from siftwell.llm import chat_format as C
from siftwell.llm.vector_search import top_k


def test_a_conversation_beyond_one_flush(spark):
    """More than a megabyte in one conversation, in one turn and in many, between short ones."""
    long = "A very long reply, said again and again. " * 40_000
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "ho"), (2, 0, "user", long), (2, 1, "assistant", long + "<|im_end|>")]
    rows += [(3, t, "assistant" if t % 2 else "user", f"turn {t} " * 200) for t in range(1200)] + [(4, 0, "assistant", "last")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    got = {r.conv_id: r for r in C.digest_output(C.format_conversations(df, P.path("byte_bpe_50k.json"))).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    for c, r in got.items():
        turns = [(role, text) for k, _, role, text in rows if k == c]
        loss = "".join(text for role, text in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()


def test_repeated_vectors(spark):
    """Candidates with one id count each; a query never meets its own id; of queries with one id the first by components asks."""
    rows = [(0, [2.0, 0.0]), (0, [1.0, 0.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [0.0, 5.0]), (2, [1.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df, df.where("vec_id = 0"), 10).collect())
    assert got == [(0, 1, 1, 3), (0, 2, 1, 3), (0, 3, 2, 1), (0, 4, 2, 0)]
