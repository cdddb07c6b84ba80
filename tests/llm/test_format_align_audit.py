"""Chat formatting, tokenizer alignment and filter audit against plain versions, with nulls, ties, repeats and control strings."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from lodestone.llm import alignment, chat_format, filter_audit
from lodestone.llm.common import written


def write_tables(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# ---- 11

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[\\INST]", "[\\\\/INST]", "<\\s>", "[SYS]", "[NEXT]", " [NEXT] ", "[ROLE]", "[SAYS] ", "[OUT]", "\\", "[", "<", "]", "\n", " ", "é", "😀"]


def conversations():
    rng = random.Random(3)
    rows = []
    for c in range(40):
        for t in range(rng.randrange(1, 9)):
            text = "".join(rng.choice([*CONTROL, "word", "Ü"]) for _ in range(rng.randrange(0, 12)))
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool", "[SAYS] x", ""]), text))
    rows += [(100, t, "assistant" if t % 5 else "user", f"t{t} [/INST]") for t in range(-3, 700)]  # several parts, messages over their edges
    rows += [(101, 1, "user", None), (101, 2, None, "x"), (101, 3, "assistant", None), (101, None, "system", "first")]
    rows += [(102, 0, "assistant", "same")] * 3 + [(102, 0, "user", "b"), (102, 0, "user", "a")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "yes")]
    rng.shuffle(rows)
    return rows


def plain_turns(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}


def plain_format(turns):
    control = re.compile(r"([\[<])(\\*)(/?(?:SYS|INST|OUT|ROLE|SAYS|NEXT)\]|/?s>)")
    escape = lambda s: control.sub(lambda m: m[1] + "\\" + m[2] + m[3], s)
    marks = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", " </s>")}
    out = ""
    for role, group in itertools.groupby(turns, key=lambda t: t[0]):
        begin, end = marks.get(role, (f"[ROLE]{escape(role)}[SAYS] ", " [/ROLE]"))
        out += begin + " [NEXT] ".join(escape(x) for _, x in group) + end
    return out


def test_conversations_are_formatted_and_read_back(spark, tmp_path):
    rows = conversations()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string").repartition(5)
    want = plain_turns(rows)
    parts = chat_format.formatted(df).collect()
    by = defaultdict(list)
    for r in sorted(parts, key=lambda r: r["part"]):
        by[r["conv_id"]].append(r)
    assert {c: "".join(r["formatted"] for r in v) for c, v in by.items()} == {c: plain_format(t) for c, t in want.items()}
    assert max(r["n_turns"] for r in parts) <= chat_format.PART and len(by[100]) == 4
    for c, v in by.items():  # the mask covers the escaped text of every assistant turn
        n = sum(len(r["loss"]) for r in v)
        assert n == sum(role == "assistant" for role, _ in want[c])
    got = chat_format.op11_chat_formatting(spark, write_tables(spark, tmp_path, conversations=df)).collect()
    want[-1] = [("user", chat_format.PROBE), ("assistant", chat_format.PROBE)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == len(want)
    for r in got:
        turns = want[r["conv_id"]]
        learnt = "".join(x for role, x in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (len(learnt), sha(learnt), len(plain_format(turns)))


def test_formatting_of_no_conversation(spark, tmp_path):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat_format.formatted(df).count() == 0
    assert [r["conv_id"] for r in chat_format.op11_chat_formatting(spark, write_tables(spark, tmp_path, conversations=df)).collect()] == [-1]


def test_formatting_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, 1, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    assert not re.search("Python|Arrow|Pandas", chat_format.formatted(df)._jdf.queryExecution().executedPlan().toString())


# ---- 12


def odd_texts(n=120):
    rng = random.Random(8)
    bits = ["hello", " world", "  ", "\n\n", "\t", "é", "ß", "日本語", "한국", "😀", "👩‍👧", "’s", "'s", "1234", "½", " ", " ", "\x1c", "\x85", "ﬁ", "á", "<s>", "<|endoftext|>", "<0x41>", "____", "====" * 9, "العربية", "naïve", "​"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(n)]
    return [*out, None, "", " ", "a", "▁", "x ▁ y", "a" * 5000, "é" * 3000, "plain words of a text", "plain words of a text", " " * 400 + "x", "\x00 zero"]


def plain_alignment(texts):
    a_tok = tokenizers.Tokenizer.from_file(alignment.BYTE_LEVEL)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
    chars = alignment.byte_of_char()
    a_bytes = lambda i: bytes(chars[c] for c in a_tok.id_to_token(i))
    b_bytes = lambda i: bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()
    out = []
    for t in texts:
        t = t or ""
        a = a_tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_tok.encode(t) if t else []
        whole = (" " + t).encode() if t else b""
        if b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            a, b = [], []
        groups, i, j = [], 0, 0
        while i < len(a):
            ga, gb = [a[i]], [b[j]]
            na, nb = len(a_bytes(a[i])), len(b_bytes(b[j]))
            while na != nb:
                if na < nb:
                    i += 1
                    ga.append(a[i])
                    na += len(a_bytes(a[i]))
                else:
                    j += 1
                    gb.append(b[j])
                    nb += len(b_bytes(b[j]))
            groups.append((ga, gb))
            i, j = i + 1, j + 1
        out.append((a, b, groups))
    return out


def test_alignment_equals_plain_version(spark, tmp_path):
    texts = odd_texts()
    rows = [(k if k % 9 else None, t, "x") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_a string").repartition(3)
    plain = plain_alignment(texts)
    pairs = Counter()
    for _, _, groups in plain:
        pairs.update({(x, y) for ga, gb in groups for x in ga for y in gb})
    top = defaultdict(int)
    for (x, _), n in pairs.items():
        top[x] = max(top[x], n)
    want = []
    for (k, _, _), (a, b, groups) in zip(rows, plain):
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        want.append((k, len(a), len(b), len(groups), len(links), sum(pairs[p] == top[p[0]] for p in links), sum(pairs[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    got = alignment.op12_tokenizer_alignment(spark, write_tables(spark, tmp_path, documents=df)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    shown = alignment.grouped(df, alignment.file_bytes(alignment.BYTE_LEVEL), alignment.file_bytes(alignment.PIECES)).collect()
    assert Counter(str([(g["a"], g["b"]) for g in r["groups"]]) for r in shown) == Counter(str([tuple(g) for g in groups]) for _, _, groups in plain)
    assert sum(w[1] == 0 for w in want) >= 4


def test_alignment_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.op12_tokenizer_alignment(spark, write_tables(spark, tmp_path, documents=df)).count() == 0


def test_wide_groups_are_linked_by_ids():
    import numpy as np

    g = alignment.Groups(np.array([1, 2] * 50), np.array([3] * 60 + [4] * 40), np.array([100]), np.array([100]), np.array([100]), np.array([100]), np.array([1]))
    text, pair, times = alignment.links(g, 10)
    assert len(pair) == 4 and int(times.sum()) == 100 * 100 and set(pair.tolist()) == {13, 14, 23, 24} and set(text.tolist()) == {0}
    assert dict(zip(pair.tolist(), times.tolist())) == {13: 3000, 14: 2000, 23: 3000, 24: 2000}


def test_long_runs_of_white_space():
    a = alignment.ByteLevel(alignment.file_bytes(alignment.BYTE_LEVEL))
    long, short = (a.encode(["x" + " " * n + "y <|endoftext|>"])[0] for n in (700_000, 70))
    assert long[:1] == short[:1] and long[-8:] == short[-8:] and b"".join(map(a.bytes.__getitem__, long)) == b"x" + b" " * 700_000 + b"y <|endoftext|>"


def test_label_string_and_spans():
    import numpy as np

    labels = alignment.label_string(np.array([2, 3, 6]), np.array([1, 3, 5, 6]), 6)
    assert labels == b"ba=.b="
    a, b = alignment.group_sizes(labels)
    assert a.tolist() == [2, 1] and b.tolist() == [2, 2]


# ---- 13


def test_filter_audit_equals_plain_version(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for k in range(300):
        n = rng.choice([5, 80, 99, 100, 130])
        few = rng.random() < 0.4
        words = [rng.choice(["a", "b", "C"]) if few else f"w{rng.randrange(10**6)}" for _ in range(n)]
        text = " ".join(words) + rng.choice(["", "", " #", " X" * 40, " Y"])
        rows.append((k, rng.choice(["en", "de", None]), text))
    rows += [(rng.choice([k + 300, 3, None]), rng.choice(["en", "fr"]), rows[rng.randrange(20)][2]) for k in range(80)]
    rows += [(900, "xx", None), (901, "xx", ""), (902, None, "\x1c \x0b"), (903, "en", rows[5][2]), (903, "en", rows[5][2])]
    rng.shuffle(rows)
    labels = [(k, rng.choice([0, 1]), rng.choice([0, 1, None])) for k in range(0, 380, 2)] + [(2, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id bigint, lang string, text string, state boolean").repartition(3)
    where = write_tables(spark, tmp_path, documents=docs, labels=spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    good, toxic = {k for k, q, _ in labels if q == 1}, {k for k, _, t in labels if t == 1}
    smallest = {}
    for k, _, t in rows:
        if k is not None:
            smallest[t or ""] = min(k, smallest.get(t or "", k))
    given = []
    for k, part, t in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        first = smallest.get(t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": first is not None and (k is None or k > first)}
        given.append((part or "", fails, k is not None and k in good, k is not None and k in toxic))
    want = {}
    for part in {g[0] for g in given}:
        own = [g for g in given if g[0] == part]
        total = Counter()
        for p in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(p, 1):
                lost = [g for g in left if g[1][x]]
                before = [g for g in own if g[1][x] and any(g[1][y] for y in p[: step - 1])]
                left = [g for g in left if not g[1][x]]
                total[x] += len(lost)
                want[part, "".join(p), step] = [x, len(left), len(lost), len(before), sum(sum(g[1].values()) == 1 and g[1][x] for g in own), sum(g[2] for g in lost), sum(g[3] for g in lost)]
        for key, v in want.items():
            if key[0] == part:
                v.append(total[v[0]])
    got = {(r["part"], r["filter_order"], r["step"]): [r["filter_order"][r["step"] - 1], r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]] for r in filter_audit.op13_filter_audit(spark, where).collect()}
    assert got == want and len(want) == 600 * 5


def test_filter_trie_makes_every_state_once(spark):
    base = spark.createDataFrame([("p", True, False, False, True, False), ("p", False, True, False, False, False), ("q", True, True, True, True, True)], "part string, fails_A boolean, fails_B boolean, fails_C boolean, good boolean, toxic boolean")
    states = filter_audit.trie(written(base, "base"), ["A", "B", "C"]).collect()
    assert sorted((r["part"], r["state"], r["n"]) for r in states) == [("p", 0, 2), ("p", 1, 1), ("p", 2, 1), ("p", 4, 2), ("p", 5, 1), ("p", 6, 1), ("q", 0, 1)]
    out = filter_audit.audit(base, ["A", "B", "C"])
    assert out.count() == 2 * 6 * 3
    assert out.filter("part = 'q'").agg(F.sum("removed")).first()[0] == 6


def test_filter_audit_of_nothing(spark, tmp_path):
    where = write_tables(spark, tmp_path, documents=spark.createDataFrame([], "doc_id bigint, lang string, text string"), labels=spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert filter_audit.op13_filter_audit(spark, where).count() == 0
    with pytest.raises(ValueError):
        filter_audit.trie(spark.range(1), list("ABCDEFG"))
