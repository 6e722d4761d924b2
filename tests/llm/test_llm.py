"""Small tests of problems 1 to 10: brute force, edge cases, ties, repeats, empty tables."""

import collections
import random
import re

import numpy as np
import pytest

from convoloom.llm import consensus, cutoff, disguise, leakage, neardup, packing, pairs, passages, repetition, residue, tails, toxicity, truncation
from convoloom.llm.words import code_tables, grams, words

MRL = "record_id long, _subset string, lang string, query string, answer string, interactions array<struct<query:string,answer:string>>, ingested_at timestamp, text string, n int"
RC = "completion_id long, _eval_id string, _subset string, conv_mode string, interactions array<struct<query:string,think:string,answer:string>>, overall_score int, ingested_at timestamp"
JL = "seq long, _eval_id string, _model string, _status string, _subset string, judgment struct<memory_score:int,overall_score:int,rationale:struct<memory:string,instruction:string,freshness:string>>, error_type string, error string, _finish_reason string"
LONG = "The old ledger lists every boat that ever came into the harbour. " * 3000


def mrl(spark, rows):
    return spark.createDataFrame([(i, "s", "en", q, a, it, None, "clash", 1) for i, q, a, it in rows], MRL)


def rc(spark, rows):
    return spark.createDataFrame([(i, f"e{i}", s, mode, [(q, t, "a") for q, t in it] if it is not None else None, sc, at) for i, s, mode, it, sc, at in rows], RC)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


# ------------------------------------------------------------------ words


def test_words_match_python():
    r = random.Random(1)
    texts = ["", None, "Straße, naïve X-12!", "a" * 5000] + ["".join(r.choice("ab é1_-. \n") for _ in range(80)) for _ in range(50)]
    w = words(texts)
    pat = re.compile(r"[^\W_]+")
    want = [(i, m.lower()) for i, t in enumerate(texts) for m in pat.findall(t or "")]
    assert len(w.hash) == len(want)
    by = {}
    for h, (i, t), row in zip(w.hash.tolist(), want, w.row.tolist(), strict=True):
        assert row == i and by.setdefault(t, h) == h
    assert len(set(by.values())) == len(by)
    h, at = grams(w, 3)
    assert len(h) == sum(max(0, len(pat.findall(t or "")) - 2) for t in texts)


def test_code_tables_match_python():
    alnum, lower = code_tables()
    assert [i for i in range(0, 0x110000) if alnum[i] != chr(i).isalnum()] == []
    assert [i for i in np.flatnonzero(alnum) if len(x := chr(i).lower()) == 1 and lower[i] != ord(x)] == []


# ------------------------------------------------------------------ problem 1


@pytest.mark.parametrize(
    "text,kind",
    [
        ("503: Service Unavailable", "error"), ("Access denied. Contact the owner.", "error"), ("Oops! this page could not be loaded.", "error"), ("<html><head><title>Error</title></head>", "error"),
        ("Traceback id 0081aa4: worker 7 timed out", "error"), ("Olbel is down for maintenance and will be back in 5 minutes.", "error"), ("Please enable JavaScript to continue", "script"), ("This page requires scripts.", "script"), ("Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.", "script"),
        ("Sample text goes here.", "filler"), ("TODO: write this one later", "filler"), ("Lorem ipsum dolor sit amet", "filler"), ("asdf qwer zzz", "filler"),
        ("Why does the site tell me to enable JavaScript?", ""), ("A 404 Not Found page says that the server has no document.", ""), ("The TODO list still has 3 items.", ""), ("Where does lorem ipsum come from?", ""), ("", ""),
    ],
)
def test_verdicts(text, kind):
    assert residue.verdict(text) == kind


@pytest.mark.parametrize("slot", ["{{ name }}", "${city}", "{% topic %}", "<<place>>", "<|persona|>", "[[topic]]", "[INSERT NAME HERE]", "@@name@@", "__CITY__", "%(name)s", "$topic$", "#city#", "{name}", "<your name>", "[user_name]", "%s"])
def test_slots(slot):
    assert residue.has_slot(f"Tell me about {slot} and why.", None)
    assert not residue.has_slot(f"Tell me about {slot} and why.", "How do I write a placeholder in a template?")


@pytest.mark.parametrize("text", ['{"fact": "oven", "value": 3}', "```python\nx = {name}\n```", "a <br> b", "{}", "[]", "[1, 2]", "see [link](x)", "50% sure", "C# and F#", None, ""])
def test_no_slots(text):
    assert not residue.has_slot(text, None)


def test_residue_operator(spark):
    rows = [(1, "Tell me about {{city}}.", "Fine text here, thanks.", []), (1, "Tell me about {{city}}.", "Fine text here, thanks.", []), (2, "What is it?", "Good answer.\n502 Bad Gateway", None), (3, None, None, None), (4, "", " ", []), (5, "Hi there", LONG + "Your answer here.", []), (6, "plain", "plain", [])]
    got = rows_of(residue.residue_fields(mrl(spark, rows)))
    assert got == [(1, "query"), (2, "answer"), (5, "answer")]
    assert rows_of(residue.residue_fields(mrl(spark, []))) == []


def test_leaf_keeps_signals():
    t = residue.Leaf()
    a, b = t.add(residue.masked("The page needs JavaScript today")), t.add(residue.masked("The page needs attention today"))
    assert a != b
    assert t.add(residue.masked("Run 12 of Alpha ended well")) == t.add(residue.masked("Run 13 of Beta ended well"))


def test_templates_are_mined_over_the_collection(spark, monkeypatch):
    """Forms that lie in different partitions and in different parts of a split leaf share one template."""
    colours = "red blue green grey white black amber brown pink gold".split()
    rows = [(i, "q", f"The old boat of Olbel was painted {c} by noon.", None) for i, c in enumerate(colours * 2)]
    for split in (2048, 6):
        monkeypatch.setattr(residue, "SPLIT", split)
        got = residue.templates(residue.parsed(mrl(spark, rows).repartition(7))).filter("form <> 'q'").collect()
        assert len(got) == 10 and {r["template"] for r in got} == {"The old boat of <*> was painted <*> by noon."}
        assert {r["n_messages"] for r in got} == {2}


def test_unseen_notice_is_found_by_statistics(spark):
    """No list holds this wording; its words are typical of the templates that the lists know, and several records carry it."""
    unseen = "Scripts, please: your browser needs JavaScript for this page."
    assert residue.verdict(unseen) == ""
    known = ["Please enable JavaScript to use this page.", "This page requires JavaScript.", "Your browser blocks scripts on this page.", "This page needs scripts.", "Please enable scripts for this browser."]
    calm = [f"The {c} boat of the harbour was sold {w} for nine coins." for c in ("red", "blue", "old", "new") for w in ("twice", "early", "late")]
    rows = [(i, "q", t, None) for i, t in enumerate([*known, *calm, unseen, "All is well. " + unseen, "What does a page mean that says please enable JavaScript?"])]
    found = {r["template"]: r["kind"] for r in residue.classified(residue.templates(residue.parsed(mrl(spark, rows)))).collect()}
    assert found.pop(unseen) == "notice" and set(found.values()) == {"script"} and len(found) == len(known)
    assert rows_of(residue.residue_fields(mrl(spark, rows))) == [(i, "answer") for i in (*range(5), 17, 18)]
    once = [r for r in rows if r[0] != 18]
    assert (17, "answer") not in rows_of(residue.residue_fields(mrl(spark, once)))


# ------------------------------------------------------------------ problem 2


def bag(*texts):
    c, out = collections.Counter(), set()
    for t in texts:
        for w in re.findall(r"[^\W_]+", (t or "").lower()):
            out.add((w, c[w]))
            c[w] += 1
    return out


def test_similar_pairs_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(60):
        base = [r.choice(vocab) for _ in range(r.randint(20, 60))]
        for _ in range(r.choice([1, 1, 3])):
            n += 1
            x = list(base)
            for _ in range(r.randint(0, len(x) // 5)):
                x[r.randrange(len(x))] = r.choice(vocab)
            r.shuffle(x)
            k = r.randint(1, len(x))
            rows.append((n, " ".join(x[:k]), None if k == len(x) else " ".join(x[k:]), [] if r.random() < 0.5 else None))
    rows += [(9001, "same words here", "twice", []), (9002, "twice", "words here SAME", None), (9001, "same words here", "twice", []), (9003, None, None, None), (9004, "", "...", [])]
    bags = {i: bag(q, a) for i, q, a, _ in rows}
    want = sorted((a, b) for a in bags for b in bags if a < b and bags[a] and bags[b] and len(bags[a] & bags[b]) >= 0.8 * len(bags[a] | bags[b]))
    assert rows_of(neardup.similar_pairs(mrl(spark, rows))) == want
    classes = {i: (c, k) for i, c, k in rows_of(neardup.near_duplicate_classes(mrl(spark, rows)))}
    assert set(classes) == {i for i, b in bags.items() if b}
    assert all(classes[a][0] == classes[b][0] for a, b in want)
    degree = collections.Counter(x for p in want for x in p)
    assert all(classes[i][1] == degree[i] for i in classes)
    assert rows_of(neardup.similar_pairs(mrl(spark, []))) == []


def test_ids_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(1, a, None, []), (1, b, None, []), (2, a, None, []), (3, b, None, []), (4, b + " more", None, []), (5, c, None, []), (6, c + " more", None, []), (7, a + " more", None, []), (7, b + " else", None, [])]
    texts = collections.defaultdict(list)
    for i, q, _, _ in rows:
        texts[i].append(bag(q))
    want = sorted((i, j) for i in texts for j in texts if i < j and any(len(x & y) >= 0.8 * len(x | y) for x in texts[i] for y in texts[j]))
    assert (2, 3) not in want and {(1, 2), (1, 3), (1, 4), (1, 7), (5, 6)} <= set(want)
    assert rows_of(neardup.similar_pairs(mrl(spark, rows))) == want
    degree = collections.Counter(x for p in want for x in p)
    assert rows_of(neardup.near_duplicate_classes(mrl(spark, rows))) == [(i, 5 if i in (5, 6) else 1, degree[i]) for i in range(1, 8)]


def test_long_chains_are_one_class(spark):
    n = 60
    chain = [1, *range(n, 1, -1)]
    apart = list(range(100, 120))
    random.Random(6).shuffle(apart)
    links = spark.createDataFrame([(min(p), max(p), 0.9) for c in (chain, apart) for p in zip(c, c[1:])], "a long, b long, similarity double")
    members = spark.createDataFrame([(i, i) for i in [*chain, *apart, 200]], "id long, rep long")
    want = [(i, 1, 1 if i in (1, 2) else 2) for i in range(1, n + 1)] + [(i, 100, 1 if i in (apart[0], apart[-1]) else 2) for i in range(100, 120)] + [(200, 200, 0)]
    assert rows_of(neardup.components(links.coalesce(1), members.coalesce(1))) == want


def test_hot_bucket_is_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SPLIT", 4)
    bands = spark.createDataFrame([(i, 7) for i in range(30)] + [(100, 8), (3, 9), (5, 9)], "id long, k long")
    assert rows_of(neardup._bucket_pairs(bands)) == [(a, b) for a in range(30) for b in range(a + 1, 30)]


def test_least_matches_prunes_safely():
    r = np.random.default_rng(0)
    least = neardup.least_matches()
    p = 0.8 + 0.2 / 256
    draws = r.random((20000, neardup.CHECK)) < p
    lost = np.zeros(20000, bool)
    for n, m in least.items():
        lost |= draws[:, :n].sum(1) < m
    assert lost.mean() < 0.01


# ------------------------------------------------------------------ problem 3


@pytest.mark.parametrize("t", [None, "", " \n", "​", "N/A", "null", "...", "{}", "''", "<br>", "-"])
def test_empty(t):
    assert pairs.defect("What is the plan for today?", t) == "empty"


def test_pair_defects():
    q = "What should Olbel bring to the old harbour for three days of sailing?"
    assert pairs.defect(q, "You asked: " + q) == "copies_query"
    assert pairs.defect(q, q.upper().replace(" ", "  ")) == "copies_query"
    assert pairs.defect(q, "I'm sorry, but I can't help with this request. Please ask about another boat.") == "refusal"
    assert pairs.defect(q, "Je suis désolé, mais je ne peux pas répondre à cette demande.") == "refusal"
    assert pairs.defect(q, "Quazu said: \"I cannot help with that\", and left. The boat was old.") == ""
    assert pairs.defect(q, "I'm sorry to hear about the boat. It was old and is gone.") == ""
    german = "Außerdem erwähnt sie, dass die Brücke am Montag kaum noch zu sehen war und nicht mehr steht."
    assert pairs.defect(q, german) == "other_language"
    assert pairs.defect(q + " Please answer in German.", german) == ""
    assert pairs.defect(None, german) == "" and pairs.language("```python\nfor turn in the list of turns: print(the, of)") == ""
    assert pairs.defect(q, "They should bring ropes, bread and " + LONG) == ""


def test_automaton_against_brute_force():
    r = random.Random(5)
    for _ in range(60):
        p = [r.choice("abc") for _ in range(r.randint(1, 12))]
        s = [r.choice("abc") for _ in range(r.randint(1, 12))]
        cover = set()
        for i in range(len(s)):
            for j in range(i + 3, len(s) + 1):
                if any(p[k : k + j - i] == s[i:j] for k in range(len(p))):
                    cover |= set(range(i, j))
        assert pairs.SuffixAutomaton(p).covered(s) == len(cover)


def test_broken_pairs_operator(spark):
    q = "What should Olbel bring to the old harbour for three days of sailing?"
    a = mrl(spark, [(1, q, None, []), (1, q, None, []), (2, q, "They bring ropes. They also take the long and wind", []), (3, "about {{x}}?", "", []), (4, q, "They bring ropes and bread to the boat.", None)])
    b = rc(spark, [(7, "s", "reasoning", [(q, "fine thought, all is well."), (q, "n/a")], 5, None), (8, "s", "instruct", [(q, "")], 5, None), (9, None, "reasoning", None, None, None)])
    assert rows_of(pairs.broken_pairs(a, b)) == [("mrl_records", 1, -1, "empty"), ("mrl_records", 2, -1, "truncated"), ("reasoning_completions", 7, 1, "empty")]
    assert rows_of(pairs.broken_pairs(mrl(spark, []), rc(spark, []))) == []


# ------------------------------------------------------------------ problem 4


def test_cutoffs_brute_force(spark):
    import datetime as dt

    r = random.Random(2)
    rows = [(i, r.choice(["a", "b", "c", None]), "x", [], r.choice([None, 0, 11, *range(1, 11)]), dt.datetime(2025, 1, r.randint(1, 3), r.randint(0, 23), i % 60)) for i in [r.randint(1, 300) for _ in range(500)]]
    rows = [(i, s, m, it, sc, at + dt.timedelta(seconds=k / 1000)) for k, (i, s, m, it, sc, at) in enumerate(rows)]
    targets = [("a", 50), ("b", 90), ("c", 1), ("none", 40)]
    last = {}
    for i, s, _, _, sc, at in rows:
        if i not in last or at > last[i][2]:
            last[i] = (s, sc, at)
    want = []
    for s, p in targets:
        v = [x for a, x, _ in last.values() if a == s and x is not None]
        best = [c for c in range(1, 11) if v and sum(x >= c for x in v) * 100 >= p * len(v)]
        if best:
            want.append((s, max(best), sum(x >= max(best) for x in v)))
    t = spark.createDataFrame(targets, "_subset string, target_pct int")
    assert rows_of(cutoff.subset_cutoffs(rc(spark, rows), t)) == sorted(want)
    assert rows_of(cutoff.subset_cutoffs(rc(spark, []), t)) == []


def test_cutoffs_on_real_scores(spark):
    r = np.random.default_rng(0)
    v = np.concatenate([r.normal(size=4000), np.full(1500, 0.25)])
    df = spark.createDataFrame([("a", float(x)) for x in v], "src string, v double")
    t = spark.createDataFrame([("a", p) for p in (37,)], "src string, p int")
    ((_, c, k, n),) = rows_of(cutoff.cutoffs(df, t, "src", "v", "p"))
    assert n == len(v) and k == (v >= c).sum() and k * 100 >= 37 * n and ((v > c).sum()) * 100 < 37 * n


def test_cutoffs_of_a_continuous_score(spark, monkeypatch):
    """A million scores, most of them different, one source with a third of them: the cutoff is the exact one, however the brackets travel."""
    from pyspark.sql import functions as F

    n = 1_000_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("s"), F.pow(F.rand(3), 3).alias("v")).cache()
    t = spark.createDataFrame([("hot", 37), ("s1", 90), ("s2", 1), ("s3", 100), ("none", 5)], "s string, p int")
    want = {}
    for s, p in (("hot", 37), ("s1", 90), ("s2", 1), ("s3", 100)):
        v = np.sort(np.array([r[0] for r in df.filter(F.col("s") == s).select("v").collect()]))[::-1]
        k = -(-len(v) * p // 100)
        want[s] = (v[k - 1], k)
    for most in (cutoff.MOST_TARGETS, 0):
        monkeypatch.setattr(cutoff, "MOST_TARGETS", most)
        assert {r["s"]: (r["cutoff"], r["n_kept"]) for r in cutoff.cutoffs(df, t, "s", "v", "p").collect()} == want
    df.unpersist()


# ------------------------------------------------------------------ problem 5


def share(text):
    w = re.findall(r"[^\W_]+", text.lower())
    seen, cov = set(), set()
    for i in range(len(w) - 2):
        g = tuple(w[i : i + 3])
        if g in seen:
            cov |= {i, i + 1, i + 2}
        seen.add(g)
    return len(cov) / len(w) if w else 0


def test_repetition_against_brute_force():
    r = random.Random(1)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 60))) for _ in range(80)]
    got = repetition.measure(texts)["share_3grams"]
    assert np.allclose(got, [share(t) for t in texts])


def test_repetition_rules():
    m = repetition.measure(["Yes. Yes. Yes. Yes.", "1. one two three\n2. one two three", "", None, "x", "A b c!\na B, c", LONG])["repeated_share"]
    assert m[0] == 0.75 and m[1] == 0.5 and m[2] == m[3] == m[4] == 0 and m[5] == 0.5 and m[6] > 0.99


def test_repeated_values(spark):
    a = mrl(spark, [(1, "q", "same words again and again. " * 5, []), (1, "q", "same words again and again. " * 5, []), (2, "q", "nothing is said twice here", None), (3, None, None, None)])
    assert rows_of(repetition.repeated_values(a, rc(spark, []))) == [("mrl_records", 1, -1)]


# ------------------------------------------------------------------ problem 6


@pytest.mark.parametrize("t", ["It ends well.", "A list:\n- red boat\n- blue boat", "Text.\n\n-- Olbel", "x = 1\n```python\nprint(1)\n```", "| a | b |\n|---|---|\n| 1 | 2 |", 'Text. {"a": 1}', "Text. 🙂", "", None, "Text.\n\nFinal value: 12 g"])
def test_complete_ends(t):
    assert truncation.judge(t) == "ended" if t else tails.ending(t) == tails.ENDED


@pytest.mark.parametrize("t", ["One is done. Two is no", "It was sai…", "f�", "```python\ndef f(", '{"memory": 3, "over', "| a | b |\n|---|---|\n| 1 | 2", "They went to the"])
def test_cut_ends(t):
    assert truncation.judge(t) in ("structure", "open", "dangling")


def test_truncated_values(spark):
    log = lambda *r: spark.createDataFrame([(i, f"e{i}", "m", "ok" if x is not None else "error", None, (1, 1, (x, None, None)) if x is not None else None, "ValueError" if x is None else None, e, " Length" if i in (1, 2) else "stop") for i, x, e in r], JL)
    full = "The reply keeps the old boat in view across all turns."
    jl = log((1, full, None), (2, "The reply keeps the old bo", None), (3, "Fine", None), (4, None, 'unterminated: {"memory_score": 3, "ov'), (5, None, "not JSON: A whole sentence."), (6, "see notes on Olbel", None), (7, "The reply keeps the old bo", None))
    a = mrl(spark, [(1, "q", "One is done. Two is no", []), (2, "q", "One is done. Two is no {{x}}", []), (3, "q", None, []), (14, "q", "All is fine. Then nobo", [])])
    assert rows_of(truncation.truncated_values(a, rc(spark, []), jl)) == [("judge_log", 2, -1), ("judge_log", 4, -1), ("judge_log", 7, -1), ("mrl_records", 1, -1), ("mrl_records", 14, -1)]
    assert {(t, n, c, said, both) for t, s, n, c, _, said, both in rows_of(truncation.truncation_rates(a, rc(spark, []), jl)) if t == "judge_log"} == {("judge_log", 7, 3, 2, 1)}
    assert {r[1]: r[3] for r in truncation.truncation_evidence(a, rc(spark, []), jl).collect()} == {2: "value", 4: "structure", 7: "value", 1: "value", 14: "open"}
    assert rows_of(truncation.truncated_values(mrl(spark, []), rc(spark, []), log())) == []


def test_cut_copies(spark):
    v = spark.createDataFrame([("x" * 40,), ("x" * 40 + "yz",), ("x" * 40,), ("z" * 40,), ("short",)], "text string")
    assert rows_of(truncation._cut_copies(v)) == [("x" * 40,)]


def test_cut_copies_of_any_length(spark):
    r = random.Random(5)
    full = ["".join(r.choice("abcdé ") for _ in range(r.randint(1, 60))) for _ in range(40)]
    v = [x for t in full for x in (t, t[: r.randint(1, len(t))], t[: r.choice([30, 31, 32, 33])])]
    want = sorted({(a,) for a in v for b in v if b != a and b.startswith(a)})
    assert {len(a) < truncation.PREFIX_CHARS for (a,) in want} == {True, False}
    assert rows_of(truncation._cut_copies(spark.createDataFrame([(x,) for x in v], "text string").repartition(5))) == want


def test_short_cut_values(spark):
    texts = ["Answers grow steady after turn 104, with Thimora barely in view.", "Answers grow stead", "Nothing contradicts the old boat.", "Nothing co", "Olbel Mora", "Olbel Mora is named.", "Mora", "Moraby asked for it.", "n/a", "n/a."]
    jl = spark.createDataFrame([(i, f"e{i}", "m", "ok", None, (1, 1, (x, None, None)), None, None, None) for i, x in enumerate(texts)], JL)
    assert rows_of(truncation.truncated_values(mrl(spark, []), rc(spark, []), jl)) == [("judge_log", 1, -1), ("judge_log", 3, -1)]


def test_passages_decide(spark):
    """Nothing in the cut text itself shows the break: only the copies of its last words do, whatever the names and numbers in them."""
    whole = [f"The old ledger of {n} lists {k} boats in the harbour" for n, k in (("Mora", 3), ("Olbel", 8))]
    texts = [*(w + "." for w in whole), "The old ledger of Vedo lists 9 boats in the harb", "The old ledger of Vedo lists", "The old ledger of Vedo lists 9 boats in the harbour", "The grey one of Vedo keeps 9 boats in the harb", "No copy shows it here"]
    jl = spark.createDataFrame([(i, f"e{i}", "m", "ok", None, (1, 1, (x, None, None)), None, None, None) for i, x in enumerate(texts)], JL)
    got = {r[1]: r[3] for r in truncation.truncation_evidence(mrl(spark, []), rc(spark, []), jl.repartition(3)).collect()}
    assert got == {2: "value", 3: "value", 5: "passage"}
    jl = jl.filter("seq <> 4")
    assert {r[1]: r[3] for r in truncation.truncation_evidence(mrl(spark, []), rc(spark, []), jl).collect()} == {2: "passage", 3: "value", 5: "passage"}


def test_short_values_and_reported_limits(spark):
    """Three whole words may be an answer; a reported limit or a broken last word tells that they are none."""
    whole = ["The old boat sails at noon.", "The old boat sails at dusk.", "They boarded the boat."]
    texts = [*((w, "stop") for w in whole), ("The old boat", "stop"), ("The old boat", "Max_Tokens"), ("The old bo", None), ("The", "length")]
    jl = spark.createDataFrame([(i, f"e{i}", "m", "ok", None, (1, 1, (x, None, None)), None, None, r) for i, (x, r) in enumerate(texts)], JL)
    assert sorted(r[1] for r in truncation.truncated_values(mrl(spark, []), rc(spark, []), jl).collect()) == [4, 5]


def test_passages_match_brute_force():
    r = random.Random(3)
    words_ = ["Olbel", "boat", "7", "old", "Mora", "lists", "harbour"]
    texts = [" ".join(r.choice(words_) for _ in range(r.randint(0, 9))) + r.choice([".", "", "!", ".\nNew boat", '."']) for _ in range(60)]
    p = passages.passages(texts)
    want = []
    for i, t in enumerate(texts):
        for line in t.split("\n"):
            for s in re.findall(r"[^.!]*[.!]?", line):
                w = re.findall(r"\w+", s)
                m = ["0" if x == "7" else "N" if k and x[0].isupper() else x.lower() for k, x in enumerate(w)]
                want += [(i, tuple(["", "", "", *m][k : k + 3]), x, k == len(w) - 1 and s[-1:] in (".", "!")) for k, x in enumerate(m)]
    assert p.row.tolist() == [x[0] for x in want] and passages.spelled(p, np.arange(len(p.row))) == [x[2] for x in want] and p.ended.tolist() == [x[3] for x in want]
    by = {}
    for k, x in zip(p.key.tolist(), want, strict=True):
        assert by.setdefault(x[1], k) == k
    assert len(set(by.values())) == len(by)


# ------------------------------------------------------------------ problem 7


def test_consensus_recovers_truth(spark):
    r = np.random.default_rng(1)
    truth = r.choice([2, 6, 9], 300)
    judges = {"good": (0.98, 0), "fair": (0.9, 0), "mild": (0.95, 2), "spam": (0.0, 0)}
    rows, k = [], 0
    for i, t in enumerate(truth):
        for m, (c, s) in judges.items():
            k += 1
            v = int(np.clip(round(r.normal(t + s, 0.6)), 1, 10)) if r.random() < c else 7 if m == "spam" else int(r.integers(1, 11))
            rows.append((k, f"e{i}", m, "ok", None, (v, v, None), None, None, None))
    rows += [(k + 1, "e0", "good", "error", None, None, "x", "x", None), (k + 2, "only_null", "good", "ok", None, (None, 99, None), None, None, None), (k + 3, None, "good", "ok", None, (1, 1, None), None, None, None)]
    items, annotators = consensus.consensus(spark.createDataFrame(rows, JL))
    got = {(e, s): b for e, s, b in rows_of(items.select("_eval_id", "score_name", "band"))}
    assert len(got) == 2 * 301
    band = {2: "low", 6: "mid", 9: "high"}
    assert np.mean([got[f"e{i}", "overall_score"] == band[t] for i, t in enumerate(truth)]) > 0.95
    c = {m: x for m, x in annotators.filter("score_name = 'overall_score'").select("_model", "competence").collect()}
    assert c["good"] > 0.85 and c["spam"] < 0.3
    assert {r["converged"] for r in annotators.collect()} == {True} and 1 < annotators.first()["rounds"] < consensus.MOST_ROUNDS
    empty = spark.createDataFrame([], JL)
    assert rows_of(consensus.consensus(empty)[0]) == []


# ------------------------------------------------------------------ problem 8


def test_best_fit_and_hilbert():
    r = random.Random(0)
    sizes = [r.randint(1, 2048) for _ in range(2000)]
    bins = packing.best_fit(sizes)
    load = collections.Counter()
    for s, b in zip(sizes, bins, strict=True):
        load[b] += s
    assert max(load.values()) <= 2048 and sum(load.values()) / (2048 * len(load)) > 0.95
    cells = np.array([[x, y] for x in range(8) for y in range(8)])
    key = packing.hilbert_key(cells, 3)
    assert sorted(key) == list(range(64))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_packing_keeps_every_token(spark):
    docs = spark.createDataFrame([(1, "hello world " * 20), (1, "hello world " * 20), (2, None), (3, ""), (4, LONG)] + [(i, "some text here " * (i % 50 + 1)) for i in range(10, 60)], "doc_id long, text string")
    out = packing.packed(docs).toPandas()
    want = packing.sized(docs).toPandas()
    assert out.n_tokens.sum() == want.n_tokens.sum()
    assert out.groupby("container_id").n_tokens.sum().max() <= 2048
    long = out[out.doc_id == 4].sort_values("piece")
    assert (long.n_tokens.iloc[:-1] == 2048).all() and (long.token_start == long.piece * 2048).all()
    assert (out[out.doc_id != 4].piece == 0).all() and (out.doc_id == 1).sum() == 2
    assert packing.packed(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ problem 9


def edits(item, text):
    for s in range(len(item) - 21):
        pat, prev = item[s : s + 22], list(range(23))
        for c in text:
            cur = [0]
            for k in range(1, 23):
                cur.append(min(prev[k - 1] + (pat[k - 1] != c), prev[k] + 1, cur[k - 1] + 1))
            prev = cur
            if prev[22] <= 3:
                return True
    return False


def leak_cases():
    r = random.Random(4)
    vocab = [f"word{i}" for i in range(150)]
    items = [(i, "Read this and answer.\n\n" + " ".join(r.choice(vocab) for _ in range(40)) + "\n\nWhat is it?") for i in range(8)]
    docs = []
    for k in range(150):
        i, t = r.choice(items)
        w = t.split("\n\n")[1].split()
        a = r.randint(0, 15)
        part = w[a : a + r.randint(18, 26)]
        for _ in range(r.randint(0, 5)):
            p = r.randrange(len(part))
            op = r.choice("sid")
            part = part[:p] + ([r.choice(vocab)] if op == "s" else [r.choice(vocab), part[p]] if op == "i" else []) + part[p + 1 :]
        docs.append((k, " ".join(r.choice(vocab) for _ in range(r.randint(0, 30))) + " " + ", ".join(part).upper() + " " + " ".join(r.choice(vocab) for _ in range(r.randint(0, 30)))))
    return items, docs


def test_windows_at_the_end_of_an_item():
    r = random.Random(8)
    item, seen = list(range(40)), collections.Counter()
    for _ in range(400):
        part = item[-r.randint(19, 24) :]
        for p in {0, *r.sample(range(6), r.randint(0, 3))} if r.random() < 0.8 else {r.randrange(len(part)) for _ in range(3)}:
            part[p] = r.randint(100, 999)
        text = [r.randint(100, 999) for _ in range(r.randint(0, 9))] + part + [r.randint(100, 999) for _ in range(r.randint(0, 9))]
        want = edits(item, text)
        assert leakage.window_within(np.array(item), np.array(text)) == want, text
        seen[want] += 1
    assert min(seen[True], seen[False]) > 40
    items = [(0, "Read this.\n\n" + " ".join(f"word{i}" for i in item))]
    index = leakage.ItemIndex([0], [items[0][1]])
    assert leakage.find(index, np.array([7]), ["Other start of it: " + " ".join(f"word{i}" for i in item[-21:])]) == [(7, 0)]


def test_leaks_brute_force(spark):
    items, docs = leak_cases()
    pat = re.compile(r"[^\W_]+")
    tok = lambda t: [x.lower() for x in pat.findall(t)]
    want = sorted((d, i) for d, t in docs for i, x in items if edits(tok(leakage.item_body(x)), tok(t)))
    assert 20 < len(want) < 140
    it = spark.createDataFrame([*items, (99, None), (98, "short")], "item_id long, text string")
    dd = spark.createDataFrame([*docs, docs[0], (900, None), (901, ""), (902, LONG)], "doc_id long, text string")
    assert rows_of(leakage.leaked(dd, it)) == want
    assert rows_of(leakage.leaked(dd, it, max_index=0)) == want
    assert rows_of(leakage.leaked(dd, it.limit(0))) == [] and rows_of(leakage.leaked(dd.limit(0), it)) == []


# ------------------------------------------------------------------ problem 10


def undisguised(t):
    raw = np.frombuffer((t + "\0").encode("utf-32-le"), np.uint32)
    return disguise.plain(raw)[0].astype("<u4").tobytes().decode("utf-32-le")[:-1]


@pytest.mark.parametrize("a,b", [("h4lfw1t", "halfwit"), ("t00", "too"), ("R o u n d up", "round up"), ("Naaaackt", "nackt"), ("sh​ows", "shows"), ("Vеlmаri", "velmari"), ("Run 510: x-12", "run 510: x-12"), ("Stop!", "stop!"), ("a b", "a b"), ("", "")])
def test_undisguise(a, b):
    assert undisguised(a) == b


def test_marginals_match_enumeration():
    import itertools

    r = np.random.default_rng(0)
    t = toxicity.tokenise(["one two three. four", "", None, "five six"])
    f = toxicity.Field(r.normal(size=(1 << toxicity.BITS, toxicity.STATES)).astype(np.float32), r.normal(size=(toxicity.STATES, toxicity.STATES)))
    p = f.marginals(t)
    s = f.scores(t.feature)
    for a, b in zip(t.bounds[:-1], t.bounds[1:], strict=True):
        total = np.zeros((b - a, toxicity.STATES))
        for path in itertools.product(range(toxicity.STATES), repeat=b - a):
            w = np.exp(sum(s[a + i, y] for i, y in enumerate(path)) + sum(f.moves[x, y] for x, y in zip(path, path[1:], strict=False)))
            for i, y in enumerate(path):
                total[i, y] += w
        assert np.allclose(p[a:b], total / total.sum(1, keepdims=True), atol=1e-5)


def test_toxicity_held_out(spark):
    r = random.Random(7)
    names = ["Olbel", "Quazu", "Marvin", "Drado", "Venar", "Kelso"]
    calm = ["The harbour of {} was sold to the museum.", "Reports from {} describe a drop of 5 percent.", "My friend {} moved to the old town.", "A notice says that {} lost the dumb bell.", "The clinic of {} offers advice on safe sex."]
    bad = {"abusive": ["Shut your mouth, {}, you pathetic moron.", "{} is a lying halfwit and should rot."], "hateful": ["All people of {} are vermin and must be driven out.", "Round up every one of {} and lock the gates."], "sexual": ["{} lay naked on the hotel bed begging for more.", "Watch uncensored nude videos of {} tonight."]}
    docs, labels = [], []
    for i in range(500):
        s = [r.choice(calm).format(r.choice(names)) for _ in range(4)]
        c = r.choice([None, None, *bad])
        if c:
            s.insert(r.randrange(5), r.choice(bad[c]).format(r.choice(names)))
        docs.append((i, " ".join(s), "src"))
        labels.append((i, "r", *(int(c == k) for k in toxicity.CATEGORIES)))
    d = spark.createDataFrame([*docs, (900, None, None), (901, "", "x"), docs[499]], "doc_id long, text string, source string")
    m = spark.createDataFrame(labels[:250], "doc_id long, reviewer string, abusive int, hateful int, sexual int")
    got = set(rows_of(toxicity.flagged(d, m)))
    want = {(x[0], k) for x in labels for k, v in zip(toxicity.CATEGORIES, x[2:], strict=True) if v}
    test = lambda s: {x for x in s if x[0] >= 250}
    assert len(test(got) & test(want)) >= 0.95 * len(test(want)) and len(test(got) - test(want)) <= 0.05 * len(test(want))
    field, cut_ = toxicity.trained(d, m)
    spans = {x["doc_id"]: x["spans"] for x in toxicity.scored(d, field).collect()}
    k = next(x[0] for x in labels[250:] if x[2])
    a = spans[k][0]
    assert a["category"] == "abusive" and any(w in docs[k][1][a["start"] : a["end"]] for w in ("moron", "halfwit"))
    assert spans[900] == [] and spans[901] == []
    assert rows_of(toxicity.flagged(d.limit(0), m)) == []
