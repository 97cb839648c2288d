"""The whole pipeline and the digests of secrets against plain Python that says the same."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from inkfold.llm import decontamination, near_duplicates, queries, secrets

WORD = "[^\x20\x09-\x0d]+"
SECRET = re.compile(r"""(?:(?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    out = [(m.start(), m.end(), 0) for m in SECRET.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def told(spans):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, b, k in spans)


def test_digests_of_secrets(spark):
    dice = random.Random(2)
    parts = ["password", "passwd", "PassWord", "secret", "api_key", "apikey", "TOKEN", "token", ":", "=", " ", "  ", '"', "'", "hunter22", "abc", "AKIA" + "Q" * 16, "AKIA" + "7" * 15, "0123456789abcdef01234567", "deadbeef", "é", "\n", "x=", ".-", "\x20:\x20", "tokén"]
    rows = [(k, "".join(dice.choice(parts) for _ in range(dice.randrange(1, 40)))) for k in range(1500)] + [(2000, None), (2001, "")]
    got = {r.doc_id: r for r in secrets.digest(secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert len(got) == len(rows)
    for k, text in rows:
        spans = base_spans(text or "")
        count = Counter(s[2] for s in spans)
        assert (got[k].n_assign, got[k].n_access, got[k].n_hex) == (count[0], count[1], count[2]), text
        assert got[k].base_sha256 == hashlib.sha256(told(spans).encode()).hexdigest()
        assert set(told(spans).split(",")) - {""} <= set(got[k].spans.split(","))


def fails(line):
    words, chars = re.findall(WORD, line), sum(map(len, re.findall(WORD, line)))
    separators, symbols = sum(c in "|>•·»" for c in line), sum(c in "#*$%&|<>" for c in line)
    stock = "cookie|javascript|privacy policy|terms of (use|service)|all rights reserved|subscribe to|sign (in|up)|log in|click here|read more|share (this|on)|skip to"
    return (separators >= 3 and separators * 4 >= len(words)) or symbols * 10 > chars or (chars <= 200 and re.search(stock, line.lower())) or (chars <= 24 and len(words) <= 2 and not re.search(r"[.!?:;,…。！？\"'”’»)\]]\s*$", line))


def cleaned(text):
    """The text that the quality rules leave, or None."""
    w = re.findall(WORD, text or "")
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    if len(w) < 50 or 100 * len(again) > 50 * len(w):
        return None
    lines = [x for x in text.split("\n") if not re.search(WORD, x) or not fails(x)]
    clean = "\n".join(lines)
    chars = lambda t: sum(map(len, re.findall(WORD, t)))
    return clean if 1 - chars(clean) / chars(text) <= 0.5 else None


def test_the_whole_pipeline(spark, tmp_path):
    dice = random.Random(8)
    words = ["".join(dice.choice("abcdefghij") for _ in range(dice.randrange(3, 9))) for _ in range(900)]
    say = lambda n: " ".join(dice.choice(words) for _ in range(n)) + "."
    item = say(20)
    rows = [(k, say(70) + "\nread more here now\n" + say(60)) for k in range(40)]
    rows += [(100, rows[3][1]), (101, rows[4][1].replace(" ", "  ", 1)), (102, " ".join(rows[5][1].split()[:-1]) + " other."), (103, say(60) + " " + item + " " + say(20)), (104, say(70) + " password=hunter22 " + say(9)), (105, "short"), (106, None), (None, say(80)), (None, say(81)), (7, say(90))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], ", ".join(("doc_id long", "text string", "lang string", "source string", "n_chars long")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [(k, c) for k, t in rows if (c := cleaned(t)) is not None]
    grams = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(WORD, t)] for i in range(len(w) - 4)}
    left.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    kept = []
    for k, t in left:  # every group of this corpus is a star around its first document
        if all(5 * len(grams(t) & grams(o)) < 4 * len(grams(t) | grams(o)) for _, o in kept):
            kept.append((k, t))
    window = set(zip(*[item.lower().rstrip(".").split()[i:] for i in range(10)], strict=False))
    lower = lambda t: re.findall("[0-9a-z]+", t.lower())
    kept = [(k, t) for k, t in kept if not window & {tuple(w[i : i + 10]) for w in [lower(t)] for i in range(len(w) - 9)}]
    kept = [(k, t.replace("password=hunter22", "[SECRET]")) for k, t in kept]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((k, len(library.encode(t, add_special_tokens=False).ids) + 1) for k, t in kept)
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    whole = pieces.filter("start = 0").collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in whole) == want
    assert pieces.agg(F.sum("length")).first()[0] == sum(n * c for (_, n), c in want.items())
    assert {100, 101, 102, 103, 105, 106}.isdisjoint({r.doc_id for r in whole}) and sum(r.doc_id == 7 for r in whole) == 2


def test_items_that_repeat_an_id_count_once(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(30))
    spark.createDataFrame([(1, text, "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text), (1, " ".join(text.split()[5:])), (1, text), (2, "w1 w2")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    row = queries.op6_decontamination(spark, str(tmp_path)).first()
    assert (row.n_hit, row.n_items, row.items_sha256) == (30, 2, hashlib.sha256(b"1,2").hexdigest())


def test_very_long_texts_in_segments(spark):
    dice = random.Random(3)
    words = [f"w{dice.randrange(40_000)}" for _ in range(900_000)]
    text = " ".join(words)
    assert len(text) > 2 * near_duplicates.CHUNK
    docs = spark.createDataFrame([(1, text), (2, text.replace(" ", "\n")), (3, " ".join(words[:850_000]))], "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates.join(docs).collect()} == {1: (1, 2), 2: (1, 2), 3: (1, 2)}
    cuts = [300_000, 449_990, 700_001]
    items = spark.createDataFrame([(k, " ".join(words[c : c + 25])) for k, c in enumerate(cuts)], "item_id long, text string")
    row = decontamination.contamination(docs.filter("doc_id = 1"), items).first()
    assert row.n_words == 900_000 and row["items"] == ["0", "1", "2"] and row.n_hit >= 75
    assert {(h.start, h.end) for h in row.hits} >= {(c, c + 10) for c in cuts}
