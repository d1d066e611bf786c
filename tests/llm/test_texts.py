"""Line dedup, chat formatting, quality rules, decontamination and license scans against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scholarframe.llm import chat, decontaminate, licenses, line_dedup, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_lines(rows):
    """Texts by (doc_id, text) after the removal of later windows."""
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = {}, {}
    for doc, text in order:
        lines = (text or "").split("\n")
        said = [i for i, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
        for k in range(len(said) - 2):
            key = tuple(lines[j] for j in said[k : k + 3])
            seen.setdefault(key, (doc, text, said[k]))
    for doc, text in order:
        lines = (text or "").split("\n")
        said = [i for i, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
        gone = set()
        for k in range(len(said) - 2):
            if seen[tuple(lines[j] for j in said[k : k + 3])] != (doc, text, said[k]):
                gone |= set(range(said[k], said[k + 2] + 1))
        out[doc, text] = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)
    return out


def test_line_dedup_brute(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", " ", "dé"]) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a\na\na\na\na"), (103, "x\ny"), (3, rows[3][1])]
    df = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in rows], "doc_id long, text string, cut int, th int, h1 string").repartition(3)
    found = line_dedup.dedup_lines(df)
    assert found.columns == ["doc_id", "text", "cut", "th", "h1", "n_removed"]
    got = [((r.doc_id), r.text, r.n_removed) for r in found.collect()]
    want = brute_lines(rows)
    assert sorted(got, key=str) == sorted(((d, *want[d, t]) for d, t in rows), key=str)


def test_line_dedup_long_and_hot(spark):
    long = "\n".join(f"line {i}" for i in range(20_000))
    rows = [(i, f"own {i}\nhead\nof\npage\ntail {i}") for i in range(300)] + [(900, long), (901, long)]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0][1] == 0 and got[7] == ("own 7\ntail 7", 3) and got[901] == ("", 20_000) and got[900][1] == 0
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\\\s>", "[\\INST] \\", None, "", "<image> <\\image>", "é<s>[/INST", "a\nb", "<</s>>"]
    rows = [(c, t, r, x) for c in range(4) for t, (r, x) in enumerate((rng, hard[(c + t) % len(hard)]) for t, rng in enumerate(["system", "user", "assistant", "user", "assistant", "we<s>ird"]))] + [(None, 0, None, "x"), (9, 0, "assistant", "z" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    made = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.digest(made).collect()}
    text = {r.conv_id: r.formatted for r in made.collect()}
    for conv in {c for c, *_ in rows}:
        own = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv].formatted_chars == len(text[conv])
        assert text[conv].count("</s>") == len(own) == text[conv].count("[INST]")


def test_chat_parts(spark):
    row = [(1, 0, "user", [("text", "see <image>", None, None), ("image", None, "s3://a.png", 2), ("audio", None, "b.wav", 3), ("text", None, None, None)]), (1, 1, "assistant", None), (1, 2, "user", [("document", None, "c.pdf", None), ("other", "odd", None, None)])]
    made = chat.format_chats(spark.createDataFrame(row, f"conv_id long, turn long, role string, parts {chat.PARTS}")).first()
    assert made.formatted == "<s>user[INST]see <\\image><image><audio>[/INST]</s><s>assistant[INST][/INST]</s><s>user[INST]<document>odd[/INST]</s>"
    assert [(a.turn, a.part, a.kind, a.ref, a.tokens) for a in made.attachments] == [(0, 1, "image", "s3://a.png", 512), (0, 2, "audio", "b.wav", 75), (2, 0, "document", "c.pdf", 1024)]
    assert made.expanded_tokens == 1611


def test_chat_parts_read_back_however_texts_are_split(spark):
    """Texts of control strings, backslashes and NULs, cut anywhere and mixed with attachments, read back part by part;
    the loss holds the assistant's texts and nothing else."""
    rng = random.Random(11)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "<image>", "<audio>", "<document>", "\\", "\0", "\0i", "\0t", "<", "[", "/s>", "é", " "]
    rows, want = [], {}
    for conv in range(60):
        turns = []
        for turn in range(rng.randint(1, 4)):
            role, parts = rng.choice(["user", "assistant", "[INST]<s>"]), []
            for _ in range(rng.randint(0, 7)):
                if rng.random() < 0.25:
                    parts.append((rng.choice(["image", "audio", "document"]), None, "r", 1))
                else:
                    text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 5)))
                    at = rng.randint(0, len(text))
                    parts += [("text", text[:at], None, None), ("text", text[at:], None, None)]
            rows.append((conv, turn, role, parts))
            joined = []
            for kind, text, *_ in parts:
                if kind != "text":
                    joined.append((kind, None))
                elif joined and joined[-1][0] == "text":
                    joined[-1] = ("text", joined[-1][1] + text)
                elif text:
                    joined.append(("text", text))
            turns.append((role, [x for x in joined if x != ("text", "")]))
        want[conv] = turns
    made = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}").repartition(3))
    for r in made.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect():
        assert [(t.role, [(p.kind, p.text) for p in t.parts]) for t in r.turns] == want[r.conv_id]
        assert r.loss == "".join(x for role, parts in want[r.conv_id] if role == "assistant" for _, x in parts if x)
        assert [a.kind for a in r.attachments] == [k for _, parts in want[r.conv_id] for k, _ in parts if k != "text"]
        assert r.formatted.count("</s>") == len(want[r.conv_id])


def test_chat_odd_rows(spark):
    kinds = "conv_id long, turn long, role string, text string, parts2 string, n int, said string"
    rows = [(1, 0, "assistant", "x", "", 1, ""), (1, 0, "assistant", "x", "", 1, ""), (1, None, None, None, None, None, None), (None, None, None, None, None, None, None)]
    made = chat.format_chats(spark.createDataFrame(rows, kinds).withColumn("parts", chat.text_part(F.col("text"))))
    assert {r.conv_id: r.formatted for r in made.collect()} == {1: "<s>[INST][/INST]</s>" + "<s>assistant[INST]x[/INST]</s>" * 2, None: "<s>[INST][/INST]</s>"}
    assert chat.digest(chat.format_chats(spark.createDataFrame([], kinds).withColumn("parts", chat.text_part(F.col("text"))))).count() == 0


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = defaultdict(list)
    for i in range(len(words) - 2):
        runs[tuple(words[i : i + 3])].append(i)
    twice = {j for at in runs.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(twice)


def test_quality_counts(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "bé", "c#", "d|", "\n", "e\te", "𝕏"]) for _ in range(n)) for n in (0, 1, 2, 3, 5, 40, 400)] + [None, "", " \n \n", "a a a a a", "x y z", "w " * 30_000]
    df = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: tuple(r)[3:] for r in quality.text_counts(df).collect()}
    assert {i: (n, c, s, d, r) for i, (n, c, s, d, r) in got.items()} == {i: brute_counts(t) for i, t in enumerate(texts)}


def test_quality_outliers_against_numpy(spark):
    import numpy as np

    rng = random.Random(4)
    rows = []
    for i in range(240):
        n = rng.randint(120, 400)
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randint(0, 99)) for _ in range(n)]
        if i % 24 == 0:
            words = [w + "***###" for w in words]
        rows.append((i, " ".join(words), "en", f"s{i % 2}", 0))
    rows += [(500, "too short", "en", "s0", 0), (501, None, None, None, None)]
    judged = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert judged[500].base_failed and not judged[501].kept and judged[501].n_words == 0
    bad = {i for i in range(240) if not judged[i].kept}
    assert bad == {i for i in range(240) if i % 24 == 0}
    # One group again by numpy: the same steps from the same starts, and the end of the smallest determinant.
    vec = {r.doc_id: [r[p] for p in quality.PARTS] for r in quality.vectors(quality.text_counts(spark.createDataFrame(rows[:240], DOCS))).collect()}
    ids = [i for i in range(240) if i % 2 == 0]
    x = np.array([vec[i] for i in ids])
    mean, cov = brute_mcd(np, x)
    assert np.allclose(squared(np, x, mean, cov), [judged[i].distance2 for i in ids], rtol=0.02, atol=0.02)


def squared(np, x, mean, cov):
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


def brute_mcd(np, x, share=0.75, steps=3):
    floor = np.diag(np.square(quality.FLOOR))
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    spread = np.sqrt(((q[2] - q[0]) / 1.349) ** 2 + np.diag(floor))
    z = (x - q[1]) / spread
    turned = z / np.sqrt(np.maximum((z**2).sum(1), 1e-9))[:, None]
    starts = [(q[1], np.diag(spread**2)), (x.mean(0), np.cov(x.T, bias=True) + floor), (q[1], turned.T @ turned / len(x) * x.shape[1] * np.outer(spread, spread) + floor)]
    ends = []
    for mean, cov in starts:
        for _ in range(steps):
            bins = np.floor(np.log(squared(np, x, mean, cov) + 1e-3) * quality.BINS)
            own = x[bins <= np.sort(bins)[int(np.ceil(share * len(x))) - 1]]
            kept = np.ceil(len(own) / len(x) * 200) / 200
            mean, cov = own.mean(0), np.cov(own.T, bias=True) * quality.consistency(kept, x.shape[1]) + floor
        ends.append((np.linalg.det(cov), mean, cov))
    return min(ends, key=lambda e: e[0])[1:]


def test_consistency_factor():
    """Of chi-square with five degrees of freedom: its quantiles, and what a share of 0.75 loses."""
    assert abs(quality.chi_square_quantile(0.999, 5) - 20.515) < 1e-3 and abs(quality.chi_square_quantile(0.95, 1) - 3.8415) < 1e-3
    assert abs(quality.consistency(0.75, 5) - 1.412) < 1e-3 and quality.consistency(1.0, 5) == 1.0


def test_determinant_decides_between_starts(spark):
    """A third of the group lies far off in one direction: the mean of all rows starts wrong, the best end does not follow it."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (300, 5)) * [1, 1, 2, 2, 2]
    x[200:] += [12, -9, 30, 0, 0]
    rows = spark.createDataFrame([(i, "l", "s", i % quality.SALTS, *map(float, v)) for i, v in enumerate(x)], "doc_id long, lang string, source string, salt int, " + ", ".join(f"{p} double" for p in quality.PARTS))
    shape = quality.robust_shapes(rows, share=0.6, steps=4)
    got = {r.doc_id: r.d2 for r in quality._distance(rows, shape).collect()}
    mean, cov = brute_mcd(np, x, 0.6, 4)
    assert np.allclose(squared(np, x, mean, cov), [got[i] for i in range(300)], rtol=0.02, atol=0.02)
    assert min(got[i] for i in range(200, 300)) > 40 > max(got[i] for i in range(200))


def test_quality_odd_rows(spark, monkeypatch):
    """Repeated rows and null ids count each, clashing names are ignored, an empty table gives no rows, and groups that
    are too many to broadcast give the same result."""
    words = lambda i: " ".join(f"w{(i * 7 + k) % 97}" for k in range(60 + i))
    rows = [(i % 9 or None, words(i), "en", None, "d", "k", 1.0) for i in range(30)] + [(7, words(7), "en", None, "d", "k", 1.0)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, salt string, start string, d2 double")
    got = sorted(quality.judge(df).collect(), key=str)
    assert len(got) == 33 and sum(r.doc_id is None for r in got) == 4 and all(r.kept for r in got)
    monkeypatch.setattr(quality, "FEW_GROUPS", 0)
    salted = sorted(quality.judge(df).collect(), key=str)
    assert [tuple(r)[:-1] for r in salted] == [tuple(r)[:-1] for r in got] and all(abs(a.distance2 - b.distance2) < 1e-9 for a, b in zip(got, salted, strict=True))
    assert quality.judge(df.limit(0)).count() == 0


def brute_hits(text, items, window=10):
    fold = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    words, hit, names = fold(text), set(), set()
    for item, t in items:
        w = fold(t)
        k = min(window, len(w))
        for run in {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else ():
            for i in range(len(words) - k + 1):
                if tuple(words[i : i + k]) == run:
                    hit |= set(range(i, i + k))
                    names.add(str(item))
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("block", [3, 100_000])
def test_decontamination_brute(spark, block):
    rng = random.Random(6)
    word = lambda: rng.choice(["Aa", "b", "ccé", "d1", "e-f"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 9, 10, 14])))) for i in range(12)] + [(7, "b b b"), (99, None)]
    texts = [", ".join(word() for _ in range(rng.randint(0, 120))) for _ in range(40)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs, bench, window=10, block=block).collect()
    for r in found:
        assert (r.n_words, r.n_hit, list(r["items"])) == brute_hits(texts[r.doc_id], items)
        raw = (texts[r.doc_id] or "").encode()
        assert sum(len(decontaminate.fold(raw[s.first_byte : s.end_byte])) for s in r.spans) == r.n_hit
    clean = {r.doc_id for r in decontaminate.clean(docs, bench, window=10, block=block).collect()}
    assert clean == {r.doc_id for r in found if r.n_hit == 0}


def test_decontamination_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in decontaminate.contamination(docs, none).collect()] == [(3, 0)]
    assert decontaminate.contamination(docs.limit(0), none).count() == 0


def test_licenses(spark):
    texts = {
        1: "Released under the MIT License.", 2: "Licensed under the Apache License, Version 2.0.", 3: None, 4: "",
        5: "This work is licensed under the GNU General Public License, version 3.", 6: "x CC-BY-NC y under the mit license under the MIT LICENSE",
        7: "Licensed under CC BY-NC 4.0.", 8: "the apache license version 3", 9: "Copyright (c) 2020 Some Body Inc. All rights reserved.",
        10: "mit license", 11: "w " * 50_000 + "under the mit license",
    }
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {i: (r.n_base, r.first_word, r.last_word, r.base_labels) for i, r in got.items()} == {
        1: (1, 1, 1, "mit"), 2: (1, 3, 3, "apache-2"), 3: (0, None, None, ""), 4: (0, None, None, ""), 5: (0, None, None, ""), 6: (3, 1, 9, "cc-by-nc,mit"),
        7: (1, 2, 2, "cc-by-nc"), 8: (0, None, None, ""), 9: (0, None, None, ""), 10: (0, None, None, ""), 11: (1, 50_000, 50_000, "mit"),
    }
    assert [got[i].labels for i in (1, 2, 5, 6, 7, 9, 10)] == ["mit", "apache-2", "gpl-3", "cc-by-nc,mit", "cc-by-nc", "all-rights-reserved", ""]
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in got.values()) and got[6].score == 0.5 and got[1].score == 1.0
    assert Counter(r.n_words for r in got.values())[0] == 2


def brute_accepts(template, words):
    """Whether the template stands somewhere in the words, by a regular expression over them."""
    pattern = ""
    for kind, count, text in licenses._MARKUP.findall(template):
        if kind == "optional":
            pattern += "(?:"
        elif kind == "end":
            pattern += ")?"
        elif count:
            pattern += rf"(?:[^ ]+ ){{0,{count}}}"
        else:
            pattern += "".join(re.escape(w.decode()) + " " for w in licenses.fold(text.encode()))
    return re.search(rf"(?:^| ){pattern}", " ".join(words) + " ") is not None


def test_token_automata_against_regular_expressions():
    """Random templates over few words, and the library's own ones, accept what their expressions find."""
    rng = random.Random(12)
    word = lambda: rng.choice(["a", "b", "c", "d"])
    found = 0
    for _ in range(400):
        template = " ".join(rng.choice([word(), word(), f"<<optional>>{word()} {word()}<<end>>", f"<<optional>>{word()}<<optional>>{word()}<<end>><<end>>", "<<any 2>>"]) for _ in range(rng.randint(1, 5))) + " " + word()
        automaton = licenses.TokenAutomaton(template)
        for _ in range(6):
            words = [word() for _ in range(rng.randint(0, 14))]
            own = [w.encode() for w in words]
            want = brute_accepts(template, words)
            assert any(automaton.accepts(own, k) for k in range(len(own))) == want
            assert not want or automaton.sign in b" " + b" ".join(own) + b" "
            found += want
    assert found > 300
    filler = "x y z".split()
    for _, _, template in licenses.TEMPLATES:
        words = [w.decode() for kind, count, text in licenses._MARKUP.findall(template) for w in (licenses.fold(text.encode()) if not kind else [])]
        automaton = licenses.TokenAutomaton(template)
        for cut in (words, words[:-1], filler + words + filler, words[1:]):
            own = [w.encode() for w in cut]
            assert any(automaton.accepts(own, k) for k in range(len(own))) == brute_accepts(template, cut)


def test_license_families_and_odd_rows(spark):
    kinds = "doc_id long, text string, labels string, score int"
    texts = ["Licensed under CC BY-NC-SA 4.0", "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "Licensed under the GNU Affero General Public License, version 3", "licensed under the GNU Lesser General Public License (LGPL) version 3"]
    got = licenses.license_scan(spark.createDataFrame([(None, t, "x", 1) for t in texts] + [(1, texts[0], "x", 1)] * 2, kinds)).collect()
    assert [r.labels for r in got] == ["cc-by-nc,cc-by-nc-sa", "cc-by-nc-nd", "agpl-3", "lgpl-3", "cc-by-nc,cc-by-nc-sa", "cc-by-nc,cc-by-nc-sa"]
    assert licenses.license_scan(spark.createDataFrame([], kinds)).count() == 0


def test_decontamination_odd_rows(spark):
    """Repeated rows and long texts are scanned each for themselves; an item without an id hits, but is not named."""
    words = [f"w{i}" for i in range(40_000)]
    bench = spark.createDataFrame([(None, " ".join(words[100:115])), (5, " ".join(words[300:312])), (5, " ".join(words[300:312]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words), 3), (1, " ".join(words), 3), (None, "w1 w2", 4)], "doc_id long, text string, spans int")
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(docs, bench).collect()]
    assert sorted(got, key=str) == sorted([(1, 40_000, 27, ["5"]), (1, 40_000, 27, ["5"]), (None, 2, 0, [])], key=str)
    assert decontaminate.clean(docs, bench).collect() == [(None, "w1 w2", 4)]
