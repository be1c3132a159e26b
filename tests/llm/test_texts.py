"""Models, tokens, fingerprints, urls, chats and decontamination."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dqscan.llm import chat_quotes, ppm_langid, rank_bpe, spaced_seeds, toxicity, url_filter, winnow
from dqscan.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string"
ODD = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x" * 3000, "ab" * 900, "it's  \n\n  we'll \t\x85  é", "\x1c\x1d a", "😀" * 300, "the" * 500 + " " * 400, "\u088f\ua7ce1 \U0001e6c0", "ß９Ⅳ²"]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rnd = random.Random(1)
    texts = ODD + ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(161, 0x2FF), rnd.randrange(0x3000, 0x9000), 32])) for _ in range(200)) for _ in range(40)]
    rows = spark.createDataFrame([*enumerate(texts), (99, None)], SCHEMA + "").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r for r in rank_bpe.encode_decode(rows, tokenizer_path()).collect()}
    for i, s in enumerate(texts):
        ids = t.encode(s, add_special_tokens=False).ids
        assert (got[i]["ids"], got[i]["decoded"], got[i]["n_tokens"]) == (ids, t.decode(ids, skip_special_tokens=False), len(ids))
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert (got[99]["n_tokens"], got[99]["decoded"]) == (0, "")
    assert rank_bpe.encode_decode(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0


def test_code_points_of_other_unicode_tables_split_as_the_library_does():
    from tokenizers import Tokenizer

    t, c = Tokenizer.from_file(tokenizer_path()), rank_bpe.Coder(rank_bpe.Vocabulary(tokenizer_path()))
    edges = [int(x, 16) for r in rank_bpe.NEWER.split() for x in r.split("-")]
    texts = [f"a{chr(p)}1 {chr(p)} {chr(p)}b" for p in sorted({q for e in edges for q in (e - 1, e, e + 1)})]
    assert [np.frombuffer(x, "<u4").tolist() for x in c.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_long_words_take_the_same_merges():
    c = rank_bpe.Coder(rank_bpe.Vocabulary(tokenizer_path()))
    rnd = random.Random(2)
    for _ in range(30):
        ids = c.of_byte[np.frombuffer("".join(rnd.choice("theanrio ") for _ in range(300)).encode(), np.uint8)].tolist()
        assert c.scanned(list(ids)) == c.heaped(list(ids))


WORDS = {"en": "the of and to in that was with for his on as this by had not but", "de": "der die und in den von zu das mit sich des auf für ist im dem nicht", "fr": "de la le et les des en un du une que est pour qui dans par plus"}


def prose(lang: str, n: int, seed: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS[lang].split()) for _ in range(n))


def test_language(spark):
    rows = [(100 * k + i, prose(lang, 30, 100 * k + i), lang) for k, lang in enumerate(WORDS) for i in range(40)]
    df = spark.createDataFrame(rows + [(900, None, "en"), (901, "", None), (902, "12 !?", "de"), (903, prose("de", 8000, 5), None), (1, rows[1][1], "en")], SCHEMA + ", lang string").withColumn("score", F.lit("clash"))
    out = ppm_langid.held_out(F.col("doc_id"), 4, 2)
    model = ppm_langid.train(df.where(~out))
    found = ppm_langid.predict(df.withColumn("language", F.lit("replaced")), model)
    assert {r["score"] for r in found.select("score").collect()} == {"clash"}
    got = {r["doc_id"]: r for r in found.select("doc_id", "language.*").collect()}
    assert all(got[d]["lang_pred"] == lang for d, _, lang in rows)
    assert [(got[d]["lang_pred"], got[d]["score"]) for d in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903]["lang_pred"] == "de" and 0 <= got[903]["score"] <= 1
    none = ppm_langid.train(spark.createDataFrame([], SCHEMA + ", lang string"))
    assert ppm_langid.predict(df, none).where("language.lang_pred <> 'und'").count() == 0
    assert ppm_langid.predict(df.limit(0), model).count() == 0


def test_code_lengths_are_those_of_ppm():
    """The tables against a direct recursion with escapes and exclusion; odds of all bytes sum to one."""
    texts = [b"abracadabra", b"cadabra abra"]
    m = ppm_langid.Model({"x": texts}, 1000)
    counts: dict[bytes, dict[int, int]] = {}
    for t in texts:
        for i, c in enumerate(t):
            for o in range(min(i, 3) + 1):
                counts.setdefault(t[i - o : i], {}).setdefault(c, 0)
                counts[t[i - o : i]][c] += 1
    kept = {c for c, s in counts.items() if sum(s.values()) >= 2}

    def p(context: bytes, byte: int) -> float:
        while context and context not in kept:
            context = context[1:]
        seen = counts[context]
        total = sum(seen.values()) + len(seen)
        if byte in seen:
            return seen[byte] / total
        lower = (lambda b: p(context[1:], b)) if context else (lambda b: 1 / 256)
        return len(seen) / total * lower(byte) / (1 - sum(lower(b) for b in seen))

    assert abs(sum(p(b"abr", b) for b in range(256)) - 1) < 1e-9
    for t in (b"abracad", b"zz top", b"dabra"):
        want = sum(-np.log2(p(t[max(0, i - 3) : i], t[i])) for i in range(len(t)))
        got = m.code_lengths(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0, 0]
        assert got == pytest.approx(want, rel=1e-5)


def test_predictions_are_the_shortest_codes(spark):
    """Every prediction, score and rate against the code lengths of all languages."""
    rows = [(100 * k + i, prose(lang, 5 + i, 100 * k + i), lang) for k, lang in enumerate(WORDS) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA + ", lang string")
    model = ppm_langid.train(df)
    for r in ppm_langid.predict(df, model).collect():
        raw = np.frombuffer(r["text"].encode(), np.uint8)
        bits = model.code_lengths(raw, np.array([0, len(raw)]))[0]
        assert r["language"]["lang_pred"] == model.languages[int(bits.argmin())]
        assert r["language"]["score"] == pytest.approx(1 / np.exp2(bits.min() - bits).sum()) and r["language"]["bits_per_byte"] == pytest.approx(bits.min() / len(raw))


def labelled(n: int, seed: int) -> tuple[list[str], list[int]]:
    rnd = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        words = [rnd.choice("tree house river walk bread night stone water green light".split()) for _ in range(12)]
        toxic = rnd.random() < 0.4
        if toxic:
            words.insert(3, rnd.choice(["vile", "nasty"]))
        if rnd.random() < (0.8 if toxic else 0.1):
            words.insert(5, "women")  # what a biased table looks like
        elif rnd.random() < 0.3:
            words.insert(5, "men")
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


def test_counterfactuals_take_the_weight_off_groups():
    texts, labels = labelled(400, 1)
    score = lambda c, t: 1 / (1 + np.exp(-c.logit(toxicity.words_of(t), c.word_weights())))
    fair, plain = toxicity.fit(texts, labels), toxicity.fit(texts, labels, penalty=0.0)
    logit = lambda c, t: c.logit(toxicity.words_of(t), c.word_weights())
    gap = lambda c: abs(logit(c, "bread for women by the river") - logit(c, "bread for men by the river"))
    assert gap(fair) < 0.1 * gap(plain)  # what the loss penalises is the change of the logit
    test, truth = labelled(200, 2)
    right = [(score(fair, t) >= 0.7) == y for t, y in zip(test, truth, strict=True)]
    assert np.mean(right) > 0.95


def test_terms_swap_where_they_stand():
    pairs, own = toxicity.counterfactuals("Men and women sing. Rain falls.")
    assert own and pairs == [({"men", "and", "women", "sing"}, {"women", "and", "sing"}), ({"men", "and", "women", "sing"}, {"men", "and", "sing"})]
    pairs, own = toxicity.counterfactuals("Rain falls. Snow too.")
    assert not own and len(pairs) == 3 and all({"rain", "falls"} <= a & b and a != b for a, b in pairs)
    assert toxicity.counterfactuals("") == toxicity.counterfactuals(None) == ([], False)


def test_neutral_mentions_are_left_alone():
    """Labelled texts name no group, but toxic words begin as some terms do; the penalty takes the false positives away."""
    rnd = random.Random(5)
    toxic = lambda: rnd.choice(["les", "tra", "wom", "mus", "ath"]) + "".join(rnd.choice("qxyzvw") for _ in range(5))
    rows = []
    for k in range(600):
        words = [rnd.choice("tree house river walk bread night stone water green light".split()) for _ in range(12)]
        rows.append((" ".join(words + ([toxic()] if k % 3 == 0 else [])) + ".", int(k % 3 == 0)))
    texts, labels = map(list, zip(*rows, strict=True))
    fair, plain = toxicity.fit(texts, labels), toxicity.fit(texts, labels, penalty=0.0)
    neutral = [f"{t} walk by the river" for row in toxicity.IDENTITY_TERMS for t in row]
    wrong = lambda c: sum(c.logit(toxicity.words_of(t), c.word_weights()) >= np.log(0.7 / 0.3) for t in neutral)
    assert wrong(plain) > 3 and wrong(fair) == 0
    assert fair.report["pairs"] == 1800 and fair.report["mean_change"] < 0.1 * plain.report["mean_change"]
    assert toxicity.mean_change(fair, texts) < 0.1 * toxicity.mean_change(plain, texts)


def test_toxicity_cases(spark):
    texts, labels = labelled(60, 3)
    docs = spark.createDataFrame([*enumerate(texts), (100, None), (101, ""), (102, "!!"), (0, texts[0]), (103, "vile " * 300_000)], SCHEMA).withColumn("row", F.lit(1))
    marks = spark.createDataFrame([*enumerate(labels), (100, 1), (None, 1), (500, 0), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(*toxicity.labelled_sample(docs, marks))
    got = toxicity.score(docs.withColumn("score", F.lit("replaced")), model).collect()
    assert len(got) == 65 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (100, 101, 102)}) == 1
    for r in got:  # by definition: the bias and the weights of all different features of the text
        found = {f for w in re.findall(r"[^\W\d_]+", (r["text"] or "").lower()) for f in ["=" + w, *(x for k in (3, 4, 6) if len(w) > k for x in ("<" + w[:k], ">" + w[-k:]))]}
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-model.bias - sum(model.weights.get(f, 0.0) for f in found))))
    assert toxicity.fit([], []).bias < -20 and toxicity.fit(["a"], [1]).weights == {}
    assert toxicity.score(docs.limit(0), model).count() == 0


URLS = [None, "noscheme/x", "http://A.COM", "HTTP://É.com:80/x", "http://example.com/en/#a", "a://www.EXAMPLE.com/en/x?y", "x://", "http://net/es/1\n2", "http://u.net/fr/", "http://spam-casino.example.org/en/5", "http://reader.example.org/en/5", "http://xnet/es/", "http://a.com/" + "p" * 3000]


def test_urls_equal_their_sql(spark):
    import duckdb

    df = spark.createDataFrame([*enumerate(URLS), (1, URLS[1]), (None, URLS[5])], "page_id long, url string")
    got = sorted(map(tuple, url_filter.judged(df.withColumn("host", F.lit(0))).collect()), key=str)
    con = duckdb.connect()
    con.register("pages", pd.DataFrame([*enumerate(URLS), (1, URLS[1]), (None, URLS[5])], columns=["page_id", "url"]).astype({"page_id": "Int64"}))
    assert got == sorted(con.sql(url_filter.oracle()).fetchall(), key=str)
    by = {r[0]: r for r in got}
    assert by[4][3:] == ("example.com/en/", "block") and by[5][3:] == ("www.example.com/en/", "allow") and by[8][3:] == ("net/fr/", "block")
    assert by[9][3:] == (None, "block") and by[10][3:] == (None, "allow") and by[11][3] is None
    assert url_filter.judged(df.limit(0)).count() == 0
    cut = df.select(url_filter.cells(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).alias("c"))
    assert [r["c"] for r in cut.collect()][: len(URLS)] == [url_filter.plain_cells(u) for u in URLS]


def test_urls_of_unseen_hosts():
    """The classifier on labelled hosts that it hasn't been trained on."""
    found = url_filter.cross_validated()
    assert found["precision"] > 0.85 and found["recall"] > 0.7


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there.\n\nHow are you?"), (1, 1, "assistant", "> How are you?\nFine, thanks"), (1, 2, "user", "> Hello there.\nA late reply"), (1, 3, "assistant", "> > how are YOU\n> Fine, thanks\nGood."),
        (1, 4, "user", ">unknown quote\nx"), (1, 5, None, None), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (None, 1, "user", "x"), (2, 1, "assistant", "b"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("said", F.lit(0))
    got = [tuple(r) for r in chat_quotes.conversations(df).orderBy("conv_id", "reply_order").collect()]
    assert [(r[1], r[4], r[6], r[7]) for r in got if r[0] == 1] == [(0, None, 0, 1), (1, 0, 1, 2), (3, 1, 2, 3), (4, 3, 0, 4), (5, 4, 0, 5), (2, 0, 1, 6)]
    assert [r[3] for r in got if r[0] == 1][:3] == ["Hello there.\n\nHow are you?", "Fine, thanks", "Good."]
    assert [r[1] for r in got if r[0] == 2] == [0, 1, 1]
    assert chat_quotes.conversations(df.limit(0)).count() == 0


def test_quotes_of_several_lines(spark):
    first, second = "p1 line one,\np1 line two\n\np2 stands alone", "Alpha is here\n\nBeta follows\nwrapped\n\nGamma ends"
    quotes = [
        ("> p1 line one,\n> p1 line two", 0, 1), ("> Alpha is here\n>\n> Beta follows\n> wrapped", 1, 1), ("> Beta follows wrapped\n>\n> Gamma\n> ends", 1, 1), ("> wrapped\n> \n> Gamma ends", 1, 1),
        ("> Alpha is here\n>\n> Gamma ends", 1, 1), ("> p1 line two\n> [...]", 0, 1), ("> p1 line\n> one p1", 0, 0), ("> Beta follows\n> Alpha is here\n>> p2 stands\n>> alone", 1, 2), (">\n> line two", None, 0),
    ]
    rows = [(c, t, "user", x) for c, (q, _, _) in enumerate(quotes) for t, x in enumerate((first, second, "between", q + "\nreply"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r["conv_id"]: (r["reply_to"], r["n_linked"]) for r in chat_quotes.conversations(df).where("turn = 3").collect()}
    assert got == {c: (to if n else 2, n) for c, (_, to, n) in enumerate(quotes)}


def planted_chats(seed: int) -> list[tuple]:
    """Conversations whose messages quote earlier ones, whole and in parts, wrapped anew, nested and altered."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    rows = []
    for conv in range(25):
        before: list[list[str]] = []  # lines of what was said
        for turn in range(rnd.randint(1, 9)):
            own = [" ".join(word() for _ in range(rnd.randint(1, 8))) if rnd.random() < 0.85 else "" for _ in range(rnd.randint(1, 5))]
            head = []
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                if before:
                    source = rnd.choice(before)
                    a = rnd.randrange(len(source))
                    lines = source[a : a + rnd.randint(1, 4)]
                    if rnd.random() < 0.3:
                        lines = " ".join(lines).split(" ", 1)
                    if rnd.random() < 0.2:
                        lines = [*lines, "unheard of"]
                    mark = rnd.choice(["> ", ">", "> > ", ">>", " > "])
                    head += [mark + (x.upper() if rnd.random() < 0.2 else x) for x in lines] + rnd.choice([[], [""], [word()]])
            before.append(own)
            text = rnd.choice(["\n", "\n", "\r\n"]).join(head + own)
            rows += [(conv, turn * 2, rnd.choice(["user", "assistant", None]), text)] * (2 if rnd.random() < 0.05 else 1)
    return rows + [(90, 0, None, None), (91, 3, "user", "> nothing before"), (None, 1, "user", "x"), (92, None, "user", "x"), (93, 1, "user", ""), (93, 1, "user", "y")]


@pytest.mark.parametrize("seed", [1, 2])
def test_quotes_equal_their_sql(spark, seed):
    """The SQL joins every run of lines with every quoted piece by its text."""
    import duckdb

    rows = planted_chats(seed)
    schema = "conv_id long, turn long, role string, text string"
    got = sorted(map(tuple, chat_quotes.conversations(spark.createDataFrame(rows, schema).withColumn("rank", F.lit("clash")).repartition(3)).collect()))
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    assert got == sorted(con.sql(chat_quotes.oracle()).fetchall())
    assert sum(r[6] for r in got) > 40  # quotes that are linked


def test_quotes_of_very_long_messages(spark):
    lines = [f"line {k} says {k * 7919 % 1000} things" for k in range(2500)]
    rows = [(1, 0, "user", "\n".join(lines)), (1, 1, "user", "short"), (1, 2, "user", "> " + "\n> ".join(lines[700:1900]) + "\nanswer"), (1, 3, "user", "w " * 200_000)]
    got = chat_quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("turn").collect()
    assert [(r["reply_to"], r["n_linked"], r["reply_order"]) for r in got] == [(None, 0, 1), (0, 0, 2), (0, 1, 3), (2, 0, 4)]
    assert got[2]["said"] == "answer"


@pytest.mark.parametrize("most", [100_000, 5])
def test_reply_order_of_long_conversations(spark, most):
    """Walked in a task, or by pointer doubling where a conversation has more than `most` messages."""
    rnd = random.Random(3)
    trees = {1: [chat_quotes.NONE, *range(3000)], 2: [chat_quotes.NONE] + [rnd.randrange(k) for k in range(1, 40)], 3: [chat_quotes.NONE, 0, chat_quotes.NONE, 2, 0], 4: [chat_quotes.NONE] + [0] * 30}
    if most == 5:
        trees[1] = trees[1][:200]
    df = spark.createDataFrame([(c, t, to) for c, x in trees.items() for t, to in enumerate(x)], "conv long, turn long, to long").repartition(3)
    got = {(r["conv"], r["turn"]): r["rank"] for r in chat_quotes.reply_ranks(df, most).collect()}
    for c, up in trees.items():
        order, stack = [], [t for t in reversed(range(len(up))) if up[t] == chat_quotes.NONE]
        while stack:
            order.append(stack.pop())
            stack += [t for t in reversed(range(len(up))) if up[t] == order[-1]]
        assert [got[c, t] for t in order] == list(range(len(up)))


def brute_fingerprint(texts: list[str]) -> list[list[tuple[int, int]]]:
    """(hash, place) entries by definition: grams ending at every unit, the rightmost least of every window."""
    units = [re.findall(r"[^\x20\x09-\x0D]{1,16}", t) for t in texts]

    def of(gram: list[str]) -> int:
        out = 0
        for u in gram:
            out = (out * 1103515245 + zlib.crc32(u.encode())) % (2**31 - 1)
        return out

    out = []
    for u in units:
        h = [of(u[max(0, i - winnow.GRAM + 1) : i + 1]) for i in range(len(u))]
        windows = [range(s, min(s + winnow.WINDOW, len(h))) for s in range(max(1, len(h) - winnow.WINDOW + 1))] if h else []
        out.append(sorted({max((p for p in w if h[p] == min(h[q] for q in w))) for w in windows}, key=int))
        out[-1] = [(h[p], p) for p in out[-1]]
    return out


def test_edited_texts(spark):
    """Edited texts, fingerprints and likeness of all lengths against their definitions."""
    rnd = random.Random(3)
    docs = [(3 * i, " ".join("".join(rnd.choice("abcdeéf") for _ in range(rnd.randint(1, 6))) for _ in range(rnd.choice([0, 1, 2, 3, 5, 11, 12, 13, 40, 300])))) for i in range(60)]
    docs += [(500, docs[4][1]), (501, None), (502, "ab" * 4000), (7, "one\nword"), (503, " \t "), (504, "w1 w2 " * 40_000), (None, "no id")]
    df = spark.createDataFrame(docs, SCHEMA).withColumn("fp", F.lit(1)).withColumn("bucket", F.lit("clash")).withColumn("id", F.lit(2))
    got = {r["doc_id"]: r for r in winnow.edited(df.repartition(5)).collect()}
    order = sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0))
    texts, edits = [t or "" for _, t in order], []
    for k, t in enumerate(texts):
        m = len(t) // 4
        edits.append(t[: len(t) - m] + texts[(k + 1) % len(texts)][:m])
    prints, changed = brute_fingerprint(texts), brute_fingerprint(edits)
    show = lambda p: " ".join(f"{h:x}@{place}" for h, place in p)

    def alike(a, b):
        a, b = {h for h, _ in a}, {h for h, _ in b}
        return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0

    for k, (d, _) in enumerate(order):
        r, after = got[d], prints[(k + 1) % len(order)]
        assert (r["n_chars"], r["edited_sha256"]) == (len(texts[k]), hashlib.sha256(edits[k].encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (show(prints[k]), show(changed[k]))
        assert r["near_edited"] == pytest.approx(alike(prints[k], changed[k])) and r["near_next"] == pytest.approx(alike(prints[k], after))
    import duckdb

    con = duckdb.connect()
    con.register("documents", pd.DataFrame([x for x in docs if x[0] != 504], columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    again = winnow.edited(df.where("doc_id is null or doc_id <> 504")).collect()
    assert sorted(map(repr, map(tuple, again))) == sorted(map(repr, con.sql(winnow.oracle()).fetchall()))
    assert got[500]["fingerprint"] == got[docs[4][0]]["fingerprint"] and got[501]["fingerprint"] == got[503]["fingerprint"] == ""
    assert np.mean([got[d]["near_edited"] for d, t in docs if t and len(t) > 200]) > 0.6
    assert winnow.edited(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(TypeError, match="whole numbers"):
        winnow.edited(df.withColumn("doc_id", F.lit("x")))


def test_texts_of_eleven_and_twelve_words_are_alike(spark):
    words = [f"word{i}" for i in range(12)]
    got = winnow.edited(spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:11])), (3, "else")], SCHEMA)).orderBy("doc_id").collect()
    assert got[0]["near_next"] > 0.6 and got[0]["near_edited"] > 0.4


def test_shared_runs_leave_a_common_entry():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    n = winnow.GRAM + winnow.WINDOW - 1
    pairs = []
    for _ in range(60):
        run = [word() for _ in range(n)]
        pairs += [" ".join([word() for _ in range(rnd.randint(0, 30))] + run + [word() for _ in range(rnd.randint(0, 30))]) for _ in range(2)]
    prints = [{h for h, _ in p} for p in brute_fingerprint(pairs)]
    assert all(prints[k] & prints[k + 1] for k in range(0, len(prints), 2))


def brute_overlap(docs, items, need=11):
    tok = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()]
    out = set()
    for d, t in docs:
        a = tok(t)
        for i, u in items:
            b = tok(u)
            for p in range(len(a) - spaced_seeds.SPAN + 1) if len(b) >= spaced_seeds.SPAN else ():
                for q in range(len(b) - spaced_seeds.SPAN + 1):
                    hit = any(all((a[p + k] if p + k < len(a) else None) == (b[q + k] if q + k < len(b) else None) for k, x in enumerate(m) if x == "1") for m in spaced_seeds.SEEDS)
                    lo, hi = -min(p, q, spaced_seeds.MARGIN), min(max(map(len, spaced_seeds.SEEDS)) + spaced_seeds.MARGIN, len(b) - q)
                    if hit and sum(p + k < len(a) and a[p + k] == b[q + k] for k in range(lo, hi)) >= min(need, -(-len(b) * 8 // 10)):
                        out.add((d, i))
    return out


@pytest.mark.parametrize("limit", [500_000, 0])
def test_short_items(spark, limit):
    filler = [f"f{i}" for i in range(20)]
    items = [(n, [f"i{n}x{k}" for k in range(n)]) for n in range(1, 12)]
    docs, want = [], set()
    for n, words in items:
        for off in range(3):
            for at in itertools.combinations(range(n), off):
                body = ["zz" if k in at else w for k, w in enumerate(words)]
                for d in ((filler + body + filler, body) if n < 8 or off < 2 or n == 10 else (filler + body + filler,)):
                    docs.append((len(docs), " ".join(d)))
                    if (off == 0) if n < 8 else (n - off) * 10 >= n * 8:
                        want.add((docs[-1][0], n))
        if n >= 8:
            docs.append((len(docs), " ".join(words[1:] + filler)))
            want.add((docs[-1][0], n))
    a, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in spaced_seeds.overlaps(a, b, max_broadcast=limit, short_items=True).collect()}
    assert got == want
    kept = {r["doc_id"] for r in spaced_seeds.clean(a, b, max_broadcast=limit, short_items=True).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_overlaps_equal_their_sql(spark):
    """Also at the end of a very long document, and where many places of a document hit many items."""
    import duckdb

    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 2)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(12, 30)))) for i in range(12)] + [(50, "the same few words again and again " * 4), (51, "the same few words again and again " * 5)]
    docs = [(i, " ".join(word() for _ in range(150)) + " " + " ".join(items[i % 12][1].split()[rnd.randint(0, 3) :])) for i in range(30)]
    docs += [(100, "filler word " * 150_000 + items[0][1]), (101, "the same few words again and again " * 60), (102, None), (103, "")]
    got = spaced_seeds.overlaps(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    want = sorted(con.sql(spaced_seeds.oracle()).fetchall())
    assert sorted(map(tuple, got.collect())) == want and {100, 101} <= {d for d, *_ in want}


@pytest.mark.parametrize("limit", [500_000, 0])
def test_items_of_a_null_id_count(spark, limit):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "before it " + text + " and after"), (2, "nothing of it " * 9)], SCHEMA)
    items = spark.createDataFrame([(None, text), (3, " ".join(f"x{i}" for i in range(20)))], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in spaced_seeds.overlaps(docs, items, max_broadcast=limit).collect()] == [(1, None)]
    assert [r["doc_id"] for r in spaced_seeds.clean(docs, items, max_broadcast=limit).collect()] == [2]


@pytest.mark.parametrize("limit", [500_000, 0])
def test_decontamination(spark, limit):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((20, 30, 9, 15, 5))] + [(7, None), (8, "")]
    docs = [(i, " ".join(word() for _ in range(60))) for i in range(8)]
    put = lambda d, t: (d, docs[d % 8][1] + " " + t + " " + docs[(d + 1) % 8][1])
    swap = items[1][1].split()
    swap[7] = swap[15] = "zzz"
    docs += [put(20, items[0][1]), put(21, " ".join(swap)), put(22, items[2][1].upper().replace(" ", ", ")), put(23, items[4][1]), (24, None), (25, ""), (26, items[3][1]), put(27, " ".join(items[1][1].split()[4:20]))]
    a, b = spark.createDataFrame(docs, SCHEMA).withColumn("hits", F.lit(0)), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in spaced_seeds.overlaps(a, b, max_broadcast=limit).collect()}
    assert got == brute_overlap(docs, items)
    assert {20, 21, 22, 26, 27} <= {d for d, _ in got} and not {d for d, _ in got} & set(range(8))
    kept = {r["doc_id"] for r in spaced_seeds.clean(a, b, max_broadcast=limit).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}
    assert spaced_seeds.overlaps(a, b.limit(0)).count() == 0 and spaced_seeds.overlaps(a.limit(0), b).count() == 0
