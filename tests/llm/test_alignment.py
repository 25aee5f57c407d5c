import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from quillspark.llm.alignment import aligned_blocks, alphabet, cross_align, pair_counts

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libs():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def brute(libs, rows):
    """Both libraries on every text, two pointers over the bytes, counts by dictionary."""
    t, sp = libs
    table, out, holds = alphabet(), [], Counter()
    for i, x in rows:
        a, b = (t.encode(" " + x, add_special_tokens=False).ids, sp.encode(x)) if x else ([], [])
        bytes_a = [bytes(table[c] for c in t.id_to_token(k)) for k in a]
        bytes_b = [bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode() for k in b]
        links, groups = [], []
        if x and b"".join(bytes_a) == b"".join(bytes_b) == b" " + x.encode():
            m = n = end_a = end_b = 0
            own_a, own_b = [], []
            end_a, end_b = len(bytes_a[0]), len(bytes_b[0])
            own_a, own_b = [a[0]], [b[0]]
            while True:
                links.append((a[m], b[n]))
                if end_a == end_b:
                    groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
                    own_a, own_b, m, n = [], [], m + 1, n + 1
                    if m == len(a):
                        break
                    own_a, own_b, end_a, end_b = [a[m]], [b[n]], end_a + len(bytes_a[m]), end_b + len(bytes_b[n])
                elif end_a < end_b:
                    m += 1
                    own_a.append(a[m])
                    end_a += len(bytes_a[m])
                else:
                    n += 1
                    own_b.append(b[n])
                    end_b += len(bytes_b[n])
        else:
            a = b = []
        holds.update(set(links))
        out.append((i, len(a), len(b), len(groups), len(links), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = defaultdict(int)
    for (x, _), n in holds.items():
        best[x] = max(best[x], n)
    return Counter((*o[:5], sum(holds[p] == best[p[0]] for p in o[5]), sum(holds[p] for p in o[5]), o[6]) for o in out)


def rows_of(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_odd_rows(edge, empty, libs):
    want = brute(libs, [tuple(r) for r in edge.select("doc_id", "text").collect()])
    got = rows_of(cross_align(edge, BPE, PIECES))
    assert got == want
    # the white-space marker in a text isn't what the text holds: no tokens
    assert (11, 0, 0, 0, 0, 0, 0, "") in got and (7, 0, 0, 0, 0, 0, 0, "") in got
    assert cross_align(empty, BPE, PIECES).collect() == []


def test_special_strings_and_scripts(spark, libs):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<s> x </s>", "<unk>", "<0x41>", " lead", "\n\nlines\n", "trail  ", "\t", "naïve café — “quotes”", "日本語 и русский", "🙂🙃", "\u0000nul", "é", "ﬁ ½ ²", "word " * 500, "don't we'll", "123456789 0x1F"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert rows_of(cross_align(docs, BPE, PIECES)) == brute(libs, list(enumerate(texts)))


def test_counts_over_blocks(spark, libs):
    """Small blocks over several partitions: counts are of the whole table."""
    texts = [f"number {i} of {i % 7} things and {'more ' * (i % 5)}" for i in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert rows_of(cross_align(docs, BPE, PIECES)) == brute(libs, list(enumerate(texts)))
    blocks = aligned_blocks(docs, BPE, PIECES)
    assert blocks.select("block").distinct().count() == 3
    rows, marked = pair_counts(blocks, 32_000)
    assert marked.count() == rows.select("pair").distinct().count() and marked.where("count > 90").count() == 0
