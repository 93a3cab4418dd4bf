"""Secret and personal-data spans against the contract's patterns, and what the methods add."""
import hashlib
import math
import random
import re
import time

from pyspark.sql import functions as F

from lettergraph.llm import pii, secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_secrets(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(out)]


def hexed(r, n):
    return "".join(r.choice("0123456789abcdef") for _ in range(n))


def mixed(r):
    return "gx_" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(36))


def secret_texts(seed):
    r = random.Random(seed)
    texts = [f"é {r.choice(['Token', 'api_key', 'APIKEY', 'passwd'])} {r.choice(['=', ':'])} \"{mixed(r)}\" and mail{i}.example.com/page{i}" for i in range(80)]
    return [*texts, None, "", "secret: token = abcdef1", "token=password=abcdefgh", "AKIA" + "A1" * 8, "AKIA123 AKIAAKIA" + "B" * 14, "ſecret: abcdefgh", "toKen=abcdefgh", "password='ab'", "f" * 23, "f" * 100_000,
            "bare " + mixed(r) + " end", "see mail7.example.com for more", texts[0], texts[0]]


def test_base_secrets_and_formats(spark):
    texts = secret_texts(1)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, secrets int")
    out = secrets.find_secrets(docs)
    assert out.columns == ["doc_id", "text", "secrets"]
    extra = {}
    for r in out.collect():
        spans = [tuple(s)[:3] for s in r.secrets]
        assert all(s.score < 0 for s in r.secrets)
        assert [s for s in spans if s[0] != "format"] == base_secrets(r.text)
        assert spans == sorted(spans, key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        for k, s, e in spans:
            if k == "format":
                extra.setdefault(r.text[s:e], 0)
    assert any(re.fullmatch("gx_[0-9A-Za-z]{36}", x) for x in extra) and not any("example" in x for x in extra)
    red = {r.doc_id: r.text for r in secrets.redacted(out).collect()}
    assert red[85] == "AKIA123 [SECRET]" if base_secrets(texts[85]) else True
    assert red[80] is None and "AKIAA1" not in red[84]


def test_no_credentials_and_empty(spark):
    docs = spark.createDataFrame([(1, "plain words, file12345678901234567890"), (2, None)], "doc_id long, text string")
    assert [r.secrets for r in secrets.find_secrets(docs).orderBy("doc_id").collect()] == [[], []]
    assert secrets.find_secrets(docs.limit(0)).collect() == []


def test_automaton_merges_and_scores():
    from collections import Counter

    r = random.Random(2)
    words = Counter(secrets.symbols(hexed(r, 32)) for _ in range(300))
    automaton = secrets.Automaton(words)
    assert automaton.states < 200
    assert automaton.score(secrets.symbols(hexed(r, 32))) > automaton.score("z" * 32) + 3


def test_tokens_are_scored_whole():
    from collections import Counter

    r = random.Random(3)
    words = Counter(secrets.symbols(hexed(r, r.randrange(40, 240))) for _ in range(400))
    grammar = secrets.Grammar({"hex": words}, Counter({"zzhz/zhzz.zz": 50}))
    start = hexed(r, 100)
    assert grammar.accepts(start) and grammar.accepts(start + hexed(r, 100))
    assert not grammar.accepts(start + "/tmp/long.path/of/words" * 10)


def test_fixed_lengths_are_learnt():
    from collections import Counter

    r = random.Random(4)
    words = Counter(secrets.symbols(hexed(r, 40)) for _ in range(160))
    grammar = secrets.Grammar({"hex": words}, Counter({"zzhz/zhzz.zz": 50, "0000": 20}))
    assert sum(grammar.accepts(hexed(r, 40)) for _ in range(200)) >= 180
    assert not any(grammar.accepts("".join(r.choice("0123456789") for _ in range(16))) or grammar.accepts(hexed(r, 20)) or grammar.accepts(hexed(r, 80)) for _ in range(100))
    tree, merged = grammar.summary()["hex"]
    assert merged < tree / 20


def slow_automaton(words, alpha):
    """The merged automaton from a partition of all prefixes: counts are summed over each part anew, parts are joined until deterministic."""
    prefixes = sorted({w[:i] for w in words for i in range(len(w) + 1)}, key=lambda p: (len(p), p))
    part = {p: p for p in prefixes}
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def members(k):
        return [p for p in prefixes if part[p] == k]

    def to(k):
        return {p[-1]: part[p] for p in prefixes if p and part[p[:-1]] == k}

    def rest(k):
        return [w[len(p) :] for p in members(k) for w, n in words.items() if w.startswith(p) for _ in range(n)]

    def join(a, b):
        for p in members(b):
            part[p] = a
        while True:
            seen = {}
            for p in prefixes:
                if p:
                    home = seen.setdefault((part[p[:-1]], p[-1]), part[p])
                    if home != part[p]:
                        gone = part[p]
                        for q in members(gone):
                            part[q] = home
                        break
            else:
                return

    def alike(a, b, seen):
        if a == b or (a, b) in seen:
            return True
        seen.add((a, b))
        x, y = rest(a), rest(b)
        slack = bound * (1 / math.sqrt(len(x)) + 1 / math.sqrt(len(y)))
        share = lambda z, f: sum(map(f, z)) / len(z)
        facts = [lambda t: t == ""] + [lambda t, c=c: t[:1] == c for c in {t[0] for t in x + y if t}] + [lambda t, k=k: len(t) <= k for k in {len(t) for t in x + y}]
        if any(abs(share(x, f) - share(y, f)) > slack for f in facts):
            return False
        ta, tb = to(a), to(b)
        return all(alike(ta[c], tb[c], seen) for c in ta.keys() & tb.keys())

    accepted, queue = [""], [("", c) for c in sorted(to(""))]
    while queue:
        p, c = queue.pop(0)
        b = to(p).get(c)
        if b is None or b in accepted:
            continue
        home = next((a for a in accepted if alike(a, b, set())), None)
        if home is None:
            accepted.append(b)
            queue += [(b, x) for x in sorted(to(b))]
        else:
            join(home, b)
            queue += [(a, x) for a in accepted for x in sorted(to(a)) if to(a)[x] not in accepted and (a, x) not in queue]

    def score(word):
        s, bits = "", 0.0
        for c in word:
            x = rest(s)
            bits += math.log2((sum(t[:1] == c for t in x) + 0.01) / (len(x) + 1))
            s = to(s).get(c, s)
        x = rest(s)
        return (bits + math.log2((x.count("") + 0.01) / (len(x) + 1))) / (len(word) + 1)

    return len(accepted), score


def test_merged_automaton_is_that_of_a_slow_merge():
    from collections import Counter

    for seed in range(4):
        r = random.Random(seed)
        shapes = [lambda: "Z" + "".join(r.choice("0h") for _ in range(6)), lambda: "z" * r.randrange(1, 5) + "-00", lambda: "".join(r.choice("0hz") for _ in range(r.randrange(2, 7)))]
        words = Counter(r.choice(shapes[: 1 + seed % 3])() for _ in range(70))
        states, score = slow_automaton(words, 0.05)
        fast = secrets.Automaton(words)
        assert fast.states == states
        for w in [*list(words)[:12], "Z0000", "z-00", "0h0h0h0h", "..."]:
            assert abs(fast.score(w) - score(w)) < 1e-9, w


def test_held_out_credentials_are_found(spark):
    r = random.Random(9)
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    formats = [lambda: mixed(r), lambda: f"T-{pick('0123456789', 12)}-{pick('ghijklmnop0123', 24)}", lambda: "ZK" + pick("ABCDEFGHIJKLMNOP0123456789", 18)]
    plain = lambda: " ".join(r.choice(["notes/of/2024", "mail.example.org", "meeting", "1234567", "report_final.txt", "4111111111111111", "2024-11-05", "Understanding", "co-operation", "ABCDEF", "e.g.something"]) for _ in range(30))
    rows = [(i, f"{plain()} token={formats[i % 3]()} {plain()}") for i in range(450)]
    planted = {1000 + i: formats[i % 3]() for i in range(300)}
    rows += [(k, f"{plain()} {v} {plain()}") for k, v in planted.items()] + [(2000 + i, plain()) for i in range(200)]
    found = {x.doc_id: [x.text[s.start : s.end] for s in x.secrets if s.kind == "format"] for x in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(v in found[k] for k, v in planted.items()) >= 0.9 * len(planted)
    wrong = sum(x != planted.get(k) for k, xs in found.items() for x in xs)
    assert wrong == 0


def test_short_and_lettered_tokens_are_candidates(spark):
    r = random.Random(6)
    word = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    texts = [f"password={word('abcdefABCDEF', 12)} some Ordinary number 1234 and nouns plainly written {i}" for i in range(300)]
    planted = {1000: word("abcdefABCDEF", 12), 1001: word("abcdef", 12)}
    docs = spark.createDataFrame([*enumerate(texts), *((k, f"use {v} wisely") for k, v in planted.items())], "doc_id long, text string")
    got = {x.doc_id: [tuple(s) for s in x.secrets] for x in secrets.find_secrets(docs).collect()}
    assert all([s[:3] for s in got[k]] == [("format", 4, 4 + len(v))] for k, v in planted.items())
    assert all([s[0] for s in got[i]] == ["assign"] for i in range(300))


def test_background_counts_all_ordinary_tokens(spark):
    from collections import Counter

    texts = [f"password=abcdef{i} token{i} word/{'x' * (i % 9)}" for i in range(200)]
    docs = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(5)
    ordinary = [w for t in texts for w in re.findall("[A-Za-z0-9+/_.=-]{6,}", t) if not w.startswith("password")]
    assert secrets.infer_grammar(docs, sample=2).bigrams == Counter(p for w in map(secrets.symbols, ordinary) for p in zip("^" + w, w + "$", strict=True))


LUHN_OK, LUHN_BAD = "4111 1111-1111 1111", "4111111111111112"


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_pii(t):
    t, out = t or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]
    return out


def pii_texts(seed):
    r = random.Random(seed)
    bits = ["a@b.c", "x_y@d.e_f@g.h", "1.2.3.4.5.6.7.8", "999.1.1.1", "0255.00001.2.3", LUHN_OK, LUHN_BAD, "4111111111111111", "+1 (555) 010-9999", "+12", "+1 2 3", "a.b@c", "@", "é漢", "5", "5 5", "1-2", ".x@y.z.", "%@a-b.c-d", "12345678901234567890", "+44(0)20..7946-0958 "]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", "-", ".", "\n"]) for _ in range(12)) for _ in range(250)]
    return [*texts, None, "", "7" * 60_000, "a" * 60_000, "a@" * 5_000, "1." * 20_000, "+1" + "-" * 50_000]


def test_base_pii(spark):
    texts = pii_texts(4)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, pii int")
    out = pii.find_pii(docs)
    assert out.columns == ["doc_id", "text", "pii"]
    for r in out.collect():
        assert [(s.kind, s.start, s.end) for s in r.pii if s.kind != "term"] == base_pii(r.text), r.text[:200]


def test_many_matches_in_one_text(spark):
    """Places are right past several blocks of matches, and a text of many of them takes no quadratic time."""
    texts = ["é " + " ".join(f"n{i}@x.org, 12 or +4{i:07}x" for i in range(n)) for n in (pii.BLOCK // 2, pii.BLOCK, pii.BLOCK + 1, 3 * pii.BLOCK + 7)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select("doc_id", pii.base_spans(F.col("text")).alias("s")).collect()
    for r in rows:
        text = texts[r.doc_id]
        mails = [("email", m.start(), m.end(), m[0]) for m in re.finditer(r"n[0-9]+@x\.org", text)]
        phones = [("phone", m.start(), m.end(), m[0]) for m in re.finditer(r"\+[0-9]+", text)]
        assert [tuple(s) for s in r.s] == mails + phones
    long = spark.createDataFrame([(1, "7 and 8 " * 30_000 + "a@b.cd")], "doc_id long, text string")
    start = time.monotonic()
    assert [s.start for s in long.select(pii.base_spans(F.col("text")).alias("s")).first().s] == [240_000]
    assert time.monotonic() - start < 40


def test_candidates_beside_many_base_spans():
    """Those that touch no span, in one pass; compared with testing each against all."""
    r = random.Random(8)
    for _ in range(200):
        classes = "".join(r.choice("0hz  ") for _ in range(120)).replace("  ", "0zh0")
        covered = sorted((s, s + r.randint(1, 30)) for s in (r.randrange(len(classes)) for _ in range(r.randint(0, 6))))
        every = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[0hz]{6,}", classes)]
        assert list(secrets._candidates(classes, covered)) == [c for c in every if not any(a < c[1] and c[0] < b for a, b in covered)]


def test_terms_that_disclose(spark):
    r = random.Random(5)
    filler = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(12))
    texts = [f"{filler()} writes Zorblax gamma jo@corp.test today {filler()} {i}" for i in range(6)] + [f"{filler()} {i} other{i}@corp.test {filler()}" for i in range(40)] + [filler() + str(i) for i in range(40)]
    texts += [texts[0], texts[0].upper(), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms, _ = pii.disclosing_terms(docs)
    found = {(t.entity, t.term) for t in terms.collect()}
    assert ("email:jo@corp.test", "zorblax") in found and not any(t in ("alpha", "beta", "gamma", "delta", "omega") for _, t in found)
    rows = {x.doc_id: x for x in pii.find_pii(docs).withColumn("clean", pii.sanitised(F.col("text"), F.col("pii"))).collect()}
    assert {s.value for s in rows[0].pii if s.kind == "term"} >= {"Zorblax"} and "Zorblax" not in rows[0].clean and "[EMAIL]" in rows[0].clean
    assert all(s.kind == "email" for s in rows[10].pii) and rows[60].pii == [] and rows[60].clean == texts[60]


def brute_terms(texts, disclosure=0.9, z=1.2816):
    """Disclosure of every (entity, term) by counting text by text, and the spans of each text."""
    different = set(texts)
    plain = lambda k, v: f"{k}:" + (re.sub("[^0-9]", "", v) if k in ("card", "phone") else v.lower())
    entities = {t: {plain(k, t[s:e]) for k, s, e in base_pii(t)} for t in different}
    words = lambda t: [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]{2,}", t or "")]
    terms = {t: {w for _, _, w in words(t)} for t in different}
    found = {}
    for e in set().union(*entities.values()):
        share = sum(e in entities[t] for t in different) / len(different)
        for w in set().union(*(terms[t] for t in different if e in entities[t])):
            both, of = sum(e in entities[t] and w in terms[t] for t in different), sum(w in terms[t] for t in different)
            if both < 2 or share == 1:
                continue
            n, p = of - 1, (both - 1) / (of - 1)
            low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            score = math.log(low / share) / math.log(1 / share)
            if score >= disclosure:
                found[e, w] = score
    spans = {}
    for t in different:
        base, told = base_pii(t), {w for e, w in found if e in entities[t]}
        spans[t] = base + [("term", s, e) for s, e, w in words(t) if w in told and not any(a < e and s < b for _, a, b in base)]
    return found, spans


def test_disclosure_against_counting(spark):
    added = 0
    for seed in range(3):
        r = random.Random(seed)
        names, people = ["Ann", "Bo", "Zorblax", "Kim7", "Élan", "ng"], ["ann@x.test", "1.2.3.4", "bo@y.test", "+44 20 7946 0958", LUHN_OK]
        texts = [None, "", "no one"]
        for _ in range(220):
            who = r.randrange(5)
            parts = [r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(r.randrange(3, 9))]
            if r.random() < 0.12:
                parts += [people[who]] + ([names[who]] if r.random() < 0.9 else [])
            elif r.random() < 0.02:
                parts.append(names[who])
            r.shuffle(parts)
            texts.append(" ".join(parts) + f" {r.randrange(150)}")
        texts += texts[5:15]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        found, spans = brute_terms(texts, 0.7)
        got = {(t.entity, t.term): t.score for t in pii.disclosing_terms(docs, disclosure=0.7)[0].collect()}
        assert got.keys() == found.keys() and all(abs(got[k] - v) < 1e-9 for k, v in found.items())
        for x in pii.find_pii(docs, disclosure=0.7).collect():
            assert [(s.kind, s.start, s.end) for s in x.pii] == spans[x.text]
            added += sum(s.kind == "term" for s in x.pii)
    assert added > 20


def test_terms_far_away_short_and_rare(spark):
    far = " ".join(["alpha beta gamma"] * 30)
    texts = [f"Ng9 writes {far} {'Zorblax' if i < 3 else far} jo@corp.test {'Zorblax' if i >= 3 else far} {i} Solo{i} {'unter' * (i + 1)}" for i in range(10)]
    texts += [f"{far} other{i}@corp.test {i} Lone{i}" for i in range(20)] + [f"{far} {i} Ng" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms, _ = pii.disclosing_terms(docs)
    found = {(t.entity, t.term): t.score for t in terms.collect()}
    # In all ten texts of the entity, whatever the distance; words of one text and common ones prove nothing.
    assert {t for _, t in found} == {"ng9", "zorblax", "writes", "jo"} and {e for e, _ in found} == {"email:jo@corp.test"}
    assert found["email:jo@corp.test", "zorblax"] > 0.94
    row = pii.find_pii(docs).where("doc_id = 9").first()
    assert [s.value for s in row.pii if s.kind == "term"] == ["Ng9", "writes", "Zorblax"]


def test_pii_digests_and_empty(spark, tmp_path):
    from lettergraph.llm.queries import op7_pii

    docs = spark.createDataFrame([(1, "a@b.cc and 1.2.3.4"), (2, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op7_pii(spark, str(tmp_path)).collect()}
    assert got[1].spans == "email:0:6,ip:11:18" and got[1].base_sha256 == hashlib.sha256(b"email:0:6,ip:11:18").hexdigest()
    assert got[2].spans == "" and got[2].n_email == 0
    assert pii.find_pii(docs.limit(0)).collect() == []


def test_long_lists_of_addresses_take_their_length(spark):
    """Ten near-equal lists: their addresses lie in the same texts, so they are counted as one, and words are placed by sorting."""
    one = [f"user{i}@host{i % 50}.test" for i in range(3000)]
    rows = [(j, " ".join([*one, f"z{j}@y.test", "owner"])) for j in range(10)] + [(100 + i, f"plain words number {i}") for i in range(200)]
    began = time.monotonic()
    out = {r.doc_id: r.pii for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.monotonic() - began < 100
    for i, t in rows:
        spans = out[i]
        assert sum(s.kind == "email" for s in spans) == (3001 if i < 10 else 0)
        assert [s.value for s in spans if s.kind == "term"] == (["owner"] if i < 10 else [])
        assert all(t[s.start : s.end] == s.value for s in spans)
