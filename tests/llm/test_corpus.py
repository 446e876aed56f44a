"""Each operator against a plain version, and its defined results in odd cases."""

import hashlib
import itertools
import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from glotspark.llm import bpe, bytewords, components, ctw, decontaminate, langid, licenses, neardup, ngramjoin, pii, piececounts, warc
from glotspark.llm.store import Stash

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is that for it with as was on be by this are or an from at which but have".split()


def words_of(rng, n, vocabulary=WORDS):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


# --- words


def test_words_and_windows_are_those_of_the_pattern():
    texts = ["", "One two\tTHREE", " a ", None, "é—ü 12x", "\n\x0b", "x" * 5000]
    arr = bytewords.arrow_texts(pa.array(texts))
    for table, pattern in ((bytewords.NOT_SPACE, "[^\x20\x09-\x0d]+"), (bytewords.ALNUM, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")):
        got = {}
        for p in bytewords.pieces(arr, table, size=8):
            raw = p.data.tobytes()
            for i in range(len(p)):
                got[p.first + i] = [raw[p.start[k] : p.end[k]].decode() for k in range(p.word_at[i], p.word_at[i + 1])]
        lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        assert got == {i: re.findall(pattern, lower(t)) for i, t in enumerate(texts)}


def test_window_hashes_do_not_depend_on_the_piece():
    arr = pa.array(["a b c d", "b c d e"])
    p = next(bytewords.pieces(arr, bytewords.NOT_SPACE))
    h, at = bytewords.windows(p.hashes(), p.word_at, 3)
    assert at.tolist() == [0, 1, 4, 5] and h[1] == h[2] and len(set(h.tolist())) == 3
    assert bytewords.whole(p.hashes()[0:3]) == h[0]


# --- components


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(100, 101)], [(5, None), (None, 5), (7, 3)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    parent = {}
    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        parent.setdefault(a, a), parent.setdefault(b, b)
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    got = dict(rows(components.components(df, Stash(spark, "t")), "node", "component"))
    assert got == {n: find(parent, n) for n in parent}


# --- 1


def plain_links(data):
    ok = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    link = {i: set() for i in range(len(data))}
    for i, j in itertools.combinations(range(len(data)), 2):
        (a, v, p), (b, w, q) = data[i], data[j]
        if a is None or b is None or p is None or p != q or not ok(v) or not ok(w) or len(v) != len(w):
            continue
        v, w = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
        if v @ w / math.sqrt(v @ v) / math.sqrt(w @ w) >= 0.98:
            link[i].add(j), link[j].add(i)
    return link


def test_near_vectors(spark):
    rng, data = random.Random(3), []
    for c in range(12):
        base = [rng.gauss(0, 1) for _ in range(16)]
        for k in range(rng.randrange(1, 30)):
            data.append((len(data), [x + rng.gauss(0, 0.08) for x in base], c % 3))
    data += [(len(data) + k, list(data[0][1]), 0) for k in range(5)]
    n = len(data)
    data += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] + [1.0] * 15, 1), (n + 4, [None] + [1.0] * 15, 1), (n + 5, data[0][1], None), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1), (None, data[0][1], 0)]
    df = spark.createDataFrame([(*d, "x") for d in data], "vec_id long, embedding array<float>, label int, rep string")
    got = {r.vec_id: r for r in neardup.link_vectors(df, block=8).collect()}
    link = plain_links(data)
    parent = {i: i for i in link}
    for i, js in link.items():
        for j in js:
            a, b = find(parent, i), find(parent, j)
            parent[max(a, b)] = min(a, b)
    for i, (vec, _, _) in enumerate(data):
        if vec is not None:
            r = got[vec]
            assert (r.n_links, r.component_id, r.kept) == (len(link[i]), find(parent, i), find(parent, i) == i), vec
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, None)
    assert neardup.link_vectors(df.limit(0)).count() == 0


# --- 2


def plain_hits(text, items, n=10):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for name, t in items:
        v = words(t)
        size = min(n, len(v))
        for k in range(len(v) - size + 1) if size else ():
            for at in range(len(w) - size + 1):
                if w[at : at + size] == v[k : k + size]:
                    hit |= set(range(at, at + size))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("max_bytes", [1 << 20, 60])
def test_decontamination(spark, max_bytes):
    rng = random.Random(5)
    items = [(k, words_of(rng, rng.choice([0, 1, 4, 10, 14]), WORDS + ["Ünï", "x9"])) for k in range(12)] + [(3, "repeated item id"), (50, None), (51, "..")]
    texts = [None, "", "!!", words_of(rng, 40), "Say: REPEATED—item  id!", items[4][1].upper().replace(" ", "--") + " tail"] + [words_of(rng, 5) + " " + rng.choice(items)[1].__str__() + "," + words_of(rng, 9) for _ in range(25)]
    docs = spark.createDataFrame([(i, t, "a", 7) for i, t in enumerate(texts)] + [(3, texts[3], "b", 8)], "doc_id long, text string, items string, n_hit int")
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = rows(decontaminate.scan(docs, tests, max_bytes=max_bytes), "doc_id", "n_words", "n_hit", "items")
    assert sorted(got) == sorted((i, *plain_hits(t, items)) for i, t in [*enumerate(texts), (3, texts[3])])
    clean = decontaminate.decontaminate(docs, tests, "span")
    assert clean.columns == docs.columns and {(r["items"], r.n_hit) for r in clean.collect()} == {("a", 7), ("b", 8)}
    assert {(r["items"], r.n_hit) for r in decontaminate.decontaminate(docs, tests).collect()} <= {("a", 7), ("b", 8)}
    assert decontaminate.scan(docs.limit(0), tests).count() == 0
    assert decontaminate.decontaminate(docs, tests).count() == sum(plain_hits(t, items)[1] == 0 for t in [*texts, texts[3]])
    assert decontaminate.scan(docs, tests.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_windows_of_long_texts_and_of_several_items(spark):
    shared = "one two three four five six seven eight nine ten eleven"
    tests = spark.createDataFrame([(1, shared), (2, f"x {shared}"), (2, "again " * 12)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "filler " * 300_000 + shared + " filler" * 9), (2, "again AGAIN, again again-again " * 30_000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.scan(docs, tests).collect()}
    assert got == {1: (300_020, 11, ["1", "2"]), 2: (150_000, 150_000, ["2"])}


def test_spans_are_cut_out(spark):
    tests = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "é One, TWO three! end"), (2, None)], "doc_id long, text string")
    assert sorted(rows(decontaminate.decontaminate(docs, tests, "span"), "doc_id", "text")) == [(1, "é ! end"), (2, None)]


# --- 3

PRIVATE = [
    "Mail john.smith@mail7.example.com or +1 (017) 555-7713 today.", "host 97.51.17.173, card 4845168114407329; 4111 1111 1111 1111", 'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" 123-45-6789',
    "Mr. John Smith met Mrs. Anna Müller. Smith left.", "Dr Иванов und Frau Schäfer", "clean: 12345 and 1.2.3 and the@",
]


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def test_surrogates(spark):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate([*PRIVATE, PRIVATE[0], "", None])], "doc_id long, text string, kinds int")
    got = {r.doc_id: r for r in pii.surrogate(df, "key").collect()}
    assert got[5].text == PRIVATE[5] and got[5].n_entities == 0
    assert got[0].text == got[6].text and got[0].kinds == ["email", "phone"]
    assert (got[7].text, got[8].text, got[8].n_entities) == ("", None, 0)
    for i, secret in ((0, "smith"), (0, "7713"), (1, "97.51.17.173"), (1, "4845168114407329"), (2, "9b0b3c"), (2, "45-6789"), (3, "Smith"), (3, "Müller"), (4, "Иванов"), (4, "Schäfer")):
        assert secret not in got[i].text
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", got[1].text)[0]
    assert luhn(card) and card != "4111 1111 1111 1111"
    assert re.fullmatch(r'token = "[0-9a-f]{40}" \d{3}-\d{2}-\d{4}', got[2].text)
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) \w+\. (\w+) left\.", got[3].text)
    assert m[1] in pii.MALE_NAMES and m[3] in pii.FEMALE_NAMES and m[2] == m[4]
    assert re.fullmatch(r"Dr [А-Яа-яЁё]{6} und Frau [A-ZÀ-ÿa-z]{7}", got[4].text)
    other = {r.doc_id: r.text for r in pii.surrogate(df, "another").collect()}
    assert other[0] != got[0].text


def test_no_word_of_a_long_name_is_left(spark):
    texts = {
        "Dr Mary Ann Evans came. Evans left.": ["Evans"], "then John Paul Jones, and Jones too": ["Jones"], "John F. Kennedy and Mr J. R. Tolkien": ["Kennedy", "Tolkien"],
        "Prof. Dr. Hans von der Leyen": ["Leyen"], "Herr Dr. Ludwig van Beethoven Bach": ["Ludwig", "Beethoven", "Bach"], "John F Smithers; Mr. J.R.R. Martin": ["Smithers", "Martin"],
        "Иван Петрович Сидоров и г-жа Кузнецова": ["Петрович", "Сидоров", "Кузнецова"], "Γιώργος Παπαδόπουλος": ["Παπαδόπουλος"], "Mr John Smith Mrs. Jones": ["Smith", "Jones"],
    }
    df = spark.createDataFrame([*enumerate(texts), (50, "Mr " + "Abel Cain " * 20000)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.surrogate(df, "key").collect()}
    for i, (text, words) in enumerate(texts.items()):
        assert not [w for w in words if w in got[i]], (text, got[i])
    assert " von der " in got[3] and got[3].startswith("Prof. Dr. ") and "г-жа" in got[6]
    assert re.fullmatch(r"\w+ [A-Z]\. \w+ and Mr [A-Z]\. [A-Z]\. \w+", got[2])
    assert "Abel" not in got[50] and "Cain" not in got[50]


def plain_number(*parts):
    return int(hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:10], 16)


LETTERS = {c: g for g in reversed([*pii.ALPHABETS, *pii.script_letters(), *("".join(map(chr, range(a, b + 1))) for a, b in pii.WIDE)]) for c in g}


def plain_substituted(value, key, kind, hexadecimal):
    for way in ("on", "back"):
        out = []
        for i, c in enumerate(value):
            low, shift = c.lower(), plain_number(key, kind, way, value[:i].lower())
            letters = pii.HEX if hexadecimal and low in pii.HEX else LETTERS.get(low, low)
            new = letters[(letters.index(low) + shift) % len(letters)]
            out.append(new.upper() if low != c else new)
        value = "".join(out)[::-1]
    return value


def plain_check(digits):
    total = 0
    for i, d in enumerate(digits[::-1]):
        twice = int(d) * 2
        total += (twice - 9 if twice > 9 else twice) if i % 2 == 0 else int(d)
    return -total % 10


def plain_surrogate(value, kind, key):
    if kind == "ip":
        a, b, c, d = map(int, value.split("."))
        left, right = a * 256 + b, c * 256 + d
        for i in range(1, 5):
            left, right = right, left ^ plain_number(key, "ip", str(i), str(right)) % 65536
        return f"{left >> 8}.{left % 256}.{right >> 8}.{right % 256}"
    if kind == "person":
        names, out = pii.next_names(key), []
        for w in value.split(" "):
            if w in [t + dot for t in pii.TITLES for dot in ("", ".")] + pii.PARTICLES:
                out.append(w)
            elif w in names:
                out.append(names[w])
            else:
                w = plain_substituted(w, key, kind, False)
                while w in names:
                    w = plain_substituted(w, key, kind, False)
                out.append(w)
        return " ".join(out)
    head = {"phone": r"^\+[0-9]{1,3}(?=[ .-])", "token": "^(?:sk-|ghp_|AKIA)?"}.get(kind)
    head = (regex.search(head, value) or [""])[0] if head else ""
    tail = regex.search(r"\.\p{L}+$", value)[0] if kind == "email" else ""
    rest = value[len(head) : len(value) - len(tail)]
    if kind in ("ssn", "card", "phone"):
        digits = re.sub("[^0-9]", "", rest)
        if kind == "card":
            new = plain_substituted(digits[:-1], key, kind, False)
            new += str((plain_check(new) + int(digits[-1]) - plain_check(digits[:-1])) % 10)
        else:
            new = plain_substituted(digits, key, kind, False)
        each = iter(new)
        return head + "".join(next(each) if c in "0123456789" else c for c in rest)
    return head + plain_substituted(rest, key, kind, kind == "token" and not head) + tail


def plain_text(text, key):
    kept = [t + dot for t in pii.TITLES for dot in ("", ".")] + pii.PARTICLES
    words = [w for m in regex.finditer(pii.PERSON, text) for w in m[0].split(" ")]
    words = list(dict.fromkeys(w for w in words if w not in kept and not regex.fullmatch(r"(?:\p{Lu}\.-?)+|\p{Lu}", w)))
    found = "(?<![\\p{L}\\p{N}])(?:" + "|".join(pii.KINDS.values())
    if words:
        sentence = r"(?<=^|[.!?…:\n]|[.!?…:][ \n\"'“„»)]{1,3})(?:%s)(?= \p{Ll})" % "|".join(pii.COMMON)
        found += rf"|(?!{sentence})(?<![\p{{L}}\p{{N}}])(?:" + "|".join(map(regex.escape, words)) + r")(?![\p{L}\p{N}])"
    kind = lambda v: next((k for k, p in pii.KINDS.items() if regex.fullmatch(p, v)), "person")
    return regex.sub(found + ")", lambda m: plain_surrogate(m[0], kind(m[0]), key), text)


def private_text(rng):
    letters = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    alphabet = rng.choice(["abcxyz", "øæþß", "דוגמ", "مثال", "иван", "αβγ", "ĀāŐő", "ไทย", "田中", "한국", "ひら"])
    name = lambda: rng.choice(["Smith", "Will", "Mark", "Иванов", "Rossi", "Zhang", "Ødegård", "O'Neil"])
    parts = [
        lambda: f"{letters(alphabet, 5)}@{letters(alphabet, 3)}{rng.randrange(9)}.{letters('abc', 3)}", lambda: ".".join(str(rng.randrange(300)) for _ in range(4)), lambda: f"+{rng.randrange(1, 99)} ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}",
        lambda: letters("0123456789", 16), lambda: letters("0123456789abcdef", 40), lambda: "sk-" + letters("abcXYZ019", 20), lambda: f"{rng.randrange(100, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}",
        lambda: f"{rng.choice(pii.TITLES)} {name()} {name()}", lambda: f"{rng.choice(pii.MALE_NAMES)} {rng.choice(['', 'F. ', 'van der '])}{name()}", lambda: rng.choice(pii.FEMALE_NAMES), name, lambda: rng.choice(["Will you", "left", "met", ". Mark my words", "said:", "\n"]),
    ]
    return "".join(rng.choice(parts)() + rng.choice([" ", ". ", ", ", "! "]) for _ in range(rng.randrange(1, 12)))


def test_surrogates_equal_the_plain_ones(spark):
    rng = random.Random(21)
    texts = [private_text(rng) for _ in range(250)]
    got = dict(rows(pii.surrogate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k"), "doc_id", "text"))
    for i, t in enumerate(texts):
        assert got[i] == plain_text(t, "k"), t


def test_names_are_replaced_at_every_mention(spark):
    texts = ["James Miller called. Later James left with Mr. Will Smith. Will you come? We saw Will.", "write to øæþ@øøø.dk or محمد@مثال.com and דוד@example.com", "Fatima Rossi met Wei Zhang. Rossi and Zhang left."]
    got = dict(rows(pii.surrogate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key"), "doc_id", "text"))
    assert not re.search("James|Miller|Smith|saw Will", got[0]) and "Will you come" in got[0]
    assert not re.search("øæþ|øøø|محمد|مثال|דוד|example", got[1])
    assert not re.search("Fatima|Rossi|Wei|Zhang", got[2])


def test_surrogates_are_distinct(spark):
    rng = random.Random(9)
    values = sorted({".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(300)} | {f"u{i}@x{i % 7}.example.com" for i in range(300)} | {f"+1 ({rng.randrange(1000):03}) 555-{i:04}" for i in range(200)} | {f"4{i:015}" for i in range(200)})
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")
    new = [t for (t,) in rows(pii.surrogate(df, "k"), "text")]
    assert len(set(new)) == len(values) and not set(new) & set(values)


def test_collisions_are_resolved(spark, monkeypatch):
    whole = pii.surrogate_of
    monkeypatch.setattr(pii, "surrogate_of", lambda value, kind, key: whole(value, kind, key) if "\x1f" in key else F.lit("same@x.com"))
    df = spark.createDataFrame([(i, f"a{i % 6}@b.com x") for i in range(12)], "doc_id long, text string")
    got = dict(rows(pii.surrogate(df, "k"), "doc_id", "text"))
    assert len(set(got.values())) == 6 and all(got[i] == got[i + 6] for i in range(6))
    assert pii.collisions(spark.createDataFrame([("email", "A@b.c", "x@y.z"), ("email", "a@b.c", "X@y.z"), ("ip", "1.1.1.1", "x@y.z")], "kind string, value string, surrogate string")).count() == 0


def test_surrogates_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "mail a@b.com " * 20000, "x", 1)], "doc_id long, text string, _found string, n_entities int")
    assert pii.surrogate(df.limit(0), "k").count() == 0
    r = pii.surrogate(df, "k").first()
    assert r["_found"] == "x" and r.n_entities == 20000 and "a@b.com" not in r.text and len(r.text) == len("mail a@b.com ") * 20000
    with pytest.raises(ValueError):
        pii.surrogate(df, "")


# --- 4


def plain_tree(texts, depth):
    counts = {}
    for t in texts:
        data = bytes(depth) + t + b"\xff"
        for p in range(depth, len(data)):
            for d in range(depth + 1):
                for b in range(8):
                    node = counts.setdefault((data[p - d : p], (1 << b) | data[p] >> (8 - b)), [0, 0])
                    node[data[p] >> (7 - b) & 1] += 1
    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    weight, share = {}, {}
    for c, node in sorted(counts, key=lambda k: -len(k[0])):
        own = kt(*counts[c, node])
        kids = [weight[k] for k in counts if len(k[0]) == len(c) + 1 and k[0][1:] == c and k[1] == node] if len(c) < depth else []
        weight[c, node] = np.logaddexp(own, sum(kids)) - math.log(2) if kids else own
        share[c, node] = math.exp(own - math.log(2) - weight[c, node]) if kids else 1.0
    return counts, share


def plain_score(t, tree, depth):
    counts, share = tree
    data, total = bytes(depth) + t + b"\xff", 0.0
    for p in range(depth, len(data)):
        for b in range(8):
            node, bit, prob, deeper = (1 << b) | data[p] >> (8 - b), data[p] >> (7 - b) & 1, 0.5, False
            for d in range(depth, -1, -1):
                key = data[p - d : p], node
                if key in counts:
                    own = (counts[key][bit] + 0.5) / (sum(counts[key]) + 1)
                    s = share[key] if deeper else 1.0
                    prob, deeper = s * own + (1 - s) * prob, True
            total += math.log10(prob)
    return total


def test_context_tree(spark):
    rng = random.Random(1)
    texts = [words_of(rng, rng.randrange(0, 9), WORDS[:6] + ["Ünder"]) for _ in range(20)] + [None, "", "  ", "zebra"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    raw = [(t or "").encode().lower() for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    assert any(held)
    train = [r for r, h in zip(raw, held) if not h]
    tree = plain_tree(train, 2)
    count = Counter(w for r in train for w in [*r.split(), None])
    n, v = sum(count.values()), len(count)
    for head in (1 << 20, 3):
        got = {r.doc_id: r for r in ctw.score(df, depth=2, max_head=head).collect()}
        for i, r in enumerate(raw):
            tokens = [*r.split(), None]
            g = got[i]
            assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[i], len(tokens), sum(count[w] > 0 for w in tokens), n)
            assert g.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens), abs=1e-9)
            assert g.score == pytest.approx(plain_score(r, tree, 2), rel=1e-5)
    small = ctw.score(df, depth=2, max_nodes=300).agg(F.min("score"), F.max("score")).first()
    assert small[0] < small[1] < 0
    assert ctw.score(df.limit(0)).count() == 0


@pytest.mark.parametrize("max_nodes", [0, 40, 300])
def test_context_tree_keeps_every_context(spark, max_nodes):
    rng = random.Random(11)
    texts = [words_of(rng, rng.randrange(1, 12), WORDS + ["Ünder", f"w{k}"]) for k in range(30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    raw = [t.encode().lower() for t in texts]
    tree = plain_tree([r for i, r in enumerate(raw) if zlib.crc32(str(i).encode()) % 7 != 2], 3)
    for r in ctw.score(df, depth=3, max_nodes=max_nodes).collect():
        want = plain_score(raw[r.doc_id], tree, 3)
        assert r.score == pytest.approx(want, rel=1e-5) and r.bits_per_byte == pytest.approx(-want / math.log10(2) / (len(raw[r.doc_id]) + 1), rel=1e-5)


@pytest.mark.parametrize("depth", [0, 1])
def test_weights_count_all_children(spark, depth):
    texts = ["aab", "aaab", "abab", "bbba", "abcabc", "aaaaaaaax", "zzzz", "yxyx", "aabaab", "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tree = plain_tree([t.encode() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2], depth)
    for r in ctw.score(df, depth=depth, max_nodes=2).collect():
        assert r.score == pytest.approx(plain_score(texts[r.doc_id].encode(), tree, depth), rel=1e-5)


def test_probabilities_sum_to_one():
    tree = ctw.Tree(0, [np.array([1], np.uint64)], [np.array([0.25], np.float32)], [np.array([1.0], np.float32)])
    assert (2 ** tree.log2(np.arange(256, dtype=np.uint64))).sum() == pytest.approx(1)


# --- 5


def test_bpe(spark):
    import public_tokenizers as P

    path, enc = P.path("byte_bpe_50k.tiktoken"), bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(2)
    texts = [None, "", " " * 300 + "a", "\u3000 \t" * 50 + "'s", "ที่นี่" * 90, "中文，" * 80, "مرحبا" * 60, "It's  a\n\ntest  ", "naïve 中文 <|endoftext|> 🙂", "a" * 3000, "x1" * 900, "word's 'll\t\t" * 700, "".join(rng.choice("ab1 .'\n é") for _ in range(5000))]
    for t in texts:
        want = enc.encode_ordinary(t or "")
        for size in (7, 100, 1 << 16):
            assert bpe.encode_text(t, enc, size).tolist() == want
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    both = bpe.round_trip(df, path, P.PATTERN)
    assert sorted(map(str, rows(both, "doc_id", "ids", "decoded"))) == sorted(map(str, rows(bpe.decode(bpe.encode(df, path, P.PATTERN), path, P.PATTERN), "doc_id", "ids", "decoded")))
    assert bpe.round_trip(df, path, P.PATTERN, keep_text=False).columns == ["doc_id", "ids", "n_tokens", "decoded"] and bpe.round_trip(df.limit(0), path, P.PATTERN).count() == 0
    out = sorted(both.collect(), key=lambda r: r.doc_id)
    assert [bytes(r.decoded) for r in out] == [(t or "").encode() for t in texts]
    assert [r.n_tokens for r in out] == [len(enc.encode_ordinary(t or "")) for t in texts]


def test_bpe_of_runs_that_the_pattern_cannot_take():
    import public_tokenizers as P

    enc = bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for run in (" " * 1_000_000, "\n" * 999_999, "a" * 1_000_000, "ب" * 300_000, "ที่" * 70_000, "1!" * 200_000, "中文" * 200_000):
        for text in (run, "head" + run + "tail", run + " x " + run):
            ids = bpe.encode_text(text, enc)
            assert enc.decode_bytes(ids.tolist()) == text.encode()
            matches = [m[0].encode() for m in bpe._matcher(P.PATTERN).finditer(text)]
            assert b"".join(matches) == text.encode()
            if len(matches) < 9:
                assert ids.tolist() == [i for m in matches for i in enc._encode_single_piece(m)]


# --- 6


def test_language_id(spark):
    rng = random.Random(4)
    vocab = {"en": "the and of water house morning people".split(), "de": "der und nicht wasser haus schön leute".split(), "fr": "le et pas maison être gens où".split()}
    data = [(i, " ".join(rng.choice(vocab[l]) for _ in range(rng.randrange(3, 60))), l, f"src{i % 3}", 0) for i, l in enumerate(["en", "de", "fr"] * 60)]
    df = spark.createDataFrame(data, DOC)
    model = langid.fit(df, rows=90)
    odd = [(1000, None, "en"), (1001, "", None), (1002, "#### 1234", "de"), (1003, "".join(rng.choice("qxzjkwvy") for _ in range(300)), "fr"), (1004, "der und nicht haus", "xx")]
    rows_ = df.select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"))
    rows_ = rows_.unionByName(spark.createDataFrame([(i, t, d, None, "de") for i, t, d in odd], "doc_id long, text string, declared string, host string, suffix string"))
    got = {r.doc_id: r for r in langid.identify(rows_, model).collect()}
    assert sum(got[i].language == l for i, _, l, *_ in data) == len(data) and all(got[i].accepted for i, *_ in data)
    assert [got[i].language for i in range(1000, 1005)] == ["und", "und", "und", "und", "de"]
    assert langid.identify(rows_.limit(0), model).count() == 0


def test_rare_languages_are_fitted(spark):
    rng = random.Random(14)
    vocab = {"en": "the and of water house morning people".split(), "de": "der und nicht wasser haus schön leute".split(), "fr": "le et pas maison être gens où".split()}
    data = [(i, " ".join(rng.choice(vocab[l]) for _ in range(30)), l) for i, l in enumerate(["en", "de"] * 400 + ["fr"])]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(df, rows=20)
    assert model.languages == ["de", "en", "fr"]
    rows_ = df.select("doc_id", "text", F.col("lang").alias("declared"), F.lit("h").alias("host"), F.lit("s").alias("suffix"))
    got = {r.doc_id: r for r in langid.identify(rows_, model).collect()}
    assert got[800].language == "fr" and got[800].accepted and all(got[i].language == l for i, _, l in data)


def plain_identify(rows_, model):
    """The fusion of langid, row by row. rows_: text, declared, host, suffix."""
    n, table = len(model.languages) + 1, model.table
    def cells(t):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode()
        d = re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", b" ", low)
        return [(((a << 16 | b << 8 | c) * 2654435761) & 0xFFFFFFFF) >> 16 for a, b, c in zip(d, d[1:], d[2:]) if not (a == b == 32)]
    logs = [[sum(table[c, k] for c in cells(t)) / 3 for k in range(n)] for t, *_ in rows_]
    soft = lambda x: [math.exp(v - max(x)) / sum(math.exp(w - max(x)) for w in x) for v in x]
    share = [soft(x) for x in logs]
    top = [(sum(s[k] for s in share) + 1 / n) / (len(rows_) + 1) for k in range(n)]
    kinds = len({r[1] for r in rows_ if r[1] is not None})
    said_sums = [sum(s[k] for s, r in zip(share, rows_) if r[1] is not None) for k in range(n)]
    out = []
    for i, (t, declared, host, suffix) in enumerate(rows_):
        def less(column, value, parent):
            if value is None:
                return parent
            others = [s for j, s in enumerate(share) if j != i and rows_[j][column] == value]
            return [(sum(s[k] for s in others) + 10 * parent[k]) / (len(others) + 10) for k in range(n)]
        prior = less(2, host, less(3, suffix, top))
        spoken = [0.0] * n if declared is None else [math.log((sum(s[k] for j, s in enumerate(share) if j != i and rows_[j][1] == declared) + 1) / (said_sums[k] + max(kinds, 1))) for k in range(n)]
        last = soft([a + math.log(p) + q for a, p, q in zip(logs[i], prior, spoken)])
        best = max(range(n), key=lambda k: last[k])
        language = "und" if not any(logs[i]) else [*model.languages, "und"][best]
        out.append((language, last[best], language != "und" and last[best] >= 0.5))
    return out


def test_fusion_equals_the_plain_one(spark):
    rng = random.Random(17)
    vocab = {"en": "the and of water house morning people".split(), "de": "der und nicht wasser haus schön leute".split(), "fr": "le et pas maison être gens où".split()}
    train = [(i, " ".join(rng.choice(vocab[l]) for _ in range(20)), l) for i, l in enumerate(["en", "de", "fr"] * 20)]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    said = [(" ".join(rng.choice(vocab[rng.choice(list(vocab))]) for _ in range(rng.randrange(0, 4))), rng.choice([None, "en", "de", "xx"]), rng.choice([None, "a.de", "b.fr", "c.com"]), rng.choice([None, "de", "com"])) for _ in range(80)]
    said += [(None, "en", None, None), ("", None, "a.de", "de"), ("12 !!", "de", "a.de", "de"), ("und " * 20_000, None, None, None)]
    df = spark.createDataFrame([(i, *r, "old") for i, r in enumerate(said)], "id long, text string, declared string, host string, suffix string, language string")
    got = {r.id: r for r in langid.identify(df, model).collect()}
    for i, (language, posterior, accepted) in enumerate(plain_identify(said, model)):
        assert (got[i].language, got[i].accepted) == (language, accepted) and got[i].posterior == pytest.approx(posterior, rel=1e-6), said[i]


def test_short_texts_lean_on_declaration_and_host(spark):
    table = np.full((1 << 16, 3), math.log(1 / (1 << 16)))
    cell, _ = langid._trigrams(np.frombuffer(b"aaaa", np.uint8), np.array([0, 4]))
    other, _ = langid._trigrams(np.frombuffer(b"bbbb", np.uint8), np.array([0, 4]))
    table[cell, 0] += 9
    table[other, 1] += 9
    model = langid.TextModel(["aa", "bb"], table)
    sure = [("aaaa aaaa", "x", "h1", None)] * 30 + [("bbbb bbbb", "y", "h2", None)] * 30
    unsure = [("aaaa bbbb", None, "h1", None), ("aaaa bbbb", None, "h2", None), ("aaaa bbbb", "x", None, None), ("aaaa bbbb", "y", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(sure + unsure)], "id long, text string, declared string, host string, suffix string")
    got = {r.id: r.language for r in langid.identify(df, model).collect()}
    assert [got[60 + i] for i in range(4)] == ["aa", "bb", "aa", "bb"]


def test_languages_of_unseen_rows(spark):
    rng = random.Random(18)
    vocab = {"en": "the and of water house morning people".split(), "de": "der und nicht wasser haus schön leute".split(), "fr": "le et pas maison être gens où".split()}
    data = [(i, " ".join(rng.choice(vocab[l]) for _ in range(12)), l) for i, l in enumerate(["en", "de", "fr"] * 60)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 3 <> 0 or doc_id < 90"))
    none = F.lit(None).cast("string")
    rest = df.where("doc_id % 3 = 0 and doc_id >= 90").unionByName(df.where("doc_id >= 150")).select("doc_id", "text", "lang", none.alias("declared"), none.alias("host"), none.alias("suffix"))
    assert langid.identify(rest, model).where("language <> lang or not accepted").count() == 0


def test_addresses(spark):
    df = spark.createDataFrame([("https://u@WWW.Example.co.de:80/x?y",), ("http://localhost",), (None,), ("nonsense",)], "u string")
    host = langid.address_host(F.col("u"))
    assert rows(df.select(host.alias("h"), langid.address_suffix(host).alias("s")), "h", "s") == [("www.example.co.de", "de"), ("localhost", None), (None, None), (None, None)]
    page = F.lit("<html class=x LANG='de-AT'><script>x</script><p>Hallo</p><!-- no -->")
    r = spark.range(1).select(langid.declared_language(page).alias("d"), F.trim(langid.visible_text(page)).alias("t")).first()
    assert (r.d, r.t) == ("de", "Hallo")


# --- 7


@pytest.mark.parametrize("chunk", [1 << 20, 64])
def test_warc(spark, chunk):
    tricky = ["x" * 150, "a\r\n\r\nWARC/1.1\r\nb" * 9, "z" * 95 + "\r\n\r\nWARC/1.1", "\r\n\r\n", "é中🙂" * 60, None, "", "short", "y" * 100]
    pages = [(i, f"http://h/{i}\n", t) for i, t in enumerate(tricky)] + [(20, "u", "x" * 150), (15, None, "x" * 150), (21, "u", "short"), (None, "u", "y" * 100), (0, "u", "x" * 150)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int").repartition(2)
    stash = Stash(spark, "t")
    warc.write(df, stash.path("w"), stash.keep(warc.repeated(df), "known"), chunk=chunk)
    got = rows(warc.verified(warc.read(spark, stash.path("w")), stash), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    first = {}
    for i, _, t in pages:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    def want(i, t):
        raw = (t or "").encode()
        revisit = len(raw) >= 100 and i != first[t]
        return i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[t] if revisit else None
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted((want(i, t) for i, _, t in pages), key=key)


def test_warc_files_split_anywhere(spark):
    df = spark.createDataFrame([(i, f"u{i}", f"{i} \r\n\r\nWARC/1.1\r\n " * (i % 5)) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    stash = Stash(spark, "t")
    warc.write(df, stash.path("w"), stash.keep(warc.repeated(df), "known"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("1997", "4096"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert warc.verified(warc.read(spark, stash.path("w")), Stash(spark, "v")).select("page_id").distinct().count() == 60
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_warc_streams_a_payload_and_checks_revisits(spark):
    big = "".join(f"line {i}\r\n\r\nWARC/1.1\r\n" for i in range(200)) + "long " * 800_000
    df = spark.createDataFrame([(1, "u", big), (2, "v", big), (3, "w", None)], "page_id long, url string, html string")
    stash = Stash(spark, "t")
    warc.write(df, stash.path("w"), stash.keep(warc.repeated(df), "known"))
    chunks = stash.keep(warc.read(spark, stash.path("w")), "read")
    assert chunks.agg(F.max(F.octet_length("payload"))).first()[0] <= warc.CHUNK
    got = {r.page_id: r for r in warc.verified(chunks, Stash(spark, "v")).collect()}
    assert (got[1].payload_bytes, got[1].payload_digest, got[2].refers_to) == (len(big), hashlib.sha256(big.encode()).hexdigest(), 1)
    assert "WARC-Date: 20" in spark.read.text(stash.path("w"), wholetext=True).first()[0]
    with pytest.raises(ValueError):
        warc.verified(chunks.where("page_id > 1"), Stash(spark, "v"))
    empty = df.limit(0)
    warc.write(empty, stash.path("none"), warc.repeated(empty))
    assert warc.verified(warc.read(spark, stash.path("none")), Stash(spark, "v")).count() == 0


# --- 8


def test_licenses(spark):
    texts = [None, "", "no notice", "x\nReleased under the MIT License.\ny", "This work is licensed under the GNU General Public License, version 2.", "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.", "license to kill", "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0."]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, licenses int")
    got = [r.licenses for r in licenses.scan(df).orderBy("doc_id").collect()]
    assert got == [[], [], [], ["MIT"], ["GPL-2.0"], ["CC-BY-NC-4.0"], [], ["Apache-2.0"]]


def test_every_template_finds_itself():
    for name, text in licenses.TEMPLATES:
        assert (name, ()) in licenses.scan_block(text)


@pytest.mark.parametrize("mark", ["", "# ", "// ", " * ", "-- ", "REM ", "dnl "])
def test_wrapped_templates_are_found_in_prose(mark):
    rng = random.Random(12)
    for name, text in licenses.TEMPLATES:
        lines = textwrap.wrap(text, 72, break_on_hyphens=False, break_long_words=False)
        lines = [*lines[: len(lines) // 2], "", *lines[len(lines) // 2 :]]
        notice = "\n".join(mark + x for x in lines)
        full = f"{words_of(rng, 90)}\n{mark}{words_of(rng, 9)}\n{notice}\n{mark}{words_of(rng, 9)}\n{words_of(rng, 90)}"
        found = [x for block in licenses.blocks(full) for x in licenses.scan_block(block)]
        assert found == [(name, ())], text


@pytest.mark.parametrize("marks", ["123", "abc", "***"])
def test_conditions_are_numbered_in_any_way(marks):
    text = next(t for n, t in licenses.TEMPLATES if n == "BSD-3-Clause" and "Neither" in t)
    for mark, begin in zip(marks, ("Redistributions of", "Redistributions in", "Neither"), strict=True):
        text = text.replace(begin, f"\n\n{mark}. {begin}")
    block, = licenses.blocks("Copyright 2020 A. Person. " + text.replace("the copyright holder", "Example Inc"))
    assert [name for name, _ in licenses.scan_block(block)] == ["BSD-3-Clause"]


def least_differences(template, block):
    """The fewest words missing from a template or standing between, over all stretches of a block."""
    low = [w.lower() for w in block]
    row = [0] * (len(low) + 1)
    for w in (x.lower() for x in template):
        new = [row[0] + 1]
        for j, b in enumerate(low, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (0 if w == b else 2)))
        row = new
    return min(row)


def test_scans_equal_the_plain_ones(spark):
    """Against all templates compared with all of a text, without candidates or ranking."""
    rng, docs = random.Random(19), []
    long = [(n, t) for n, t in licenses.TEMPLATES if len(licenses.words(t)) >= 12]
    for k in range(9):
        name, text = rng.choice(long)
        said = licenses.words(text)
        changed = rng.sample([i for i, w in enumerate(said) if w.islower()], rng.choice([0, 0, 1, len(said) // 4]))
        docs.append((k, f"{words_of(rng, 20)}\n" + textwrap.fill(" ".join("zebra" if i in changed else w for i, w in enumerate(said)), 60) + f"\n{words_of(rng, 20)}", 1))
    docs += [(100, words_of(rng, 300), 1), (101, None, 1), (102, "Released under the MIT License. " * 4000, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_blocks int")
    got = {r.doc_id: set(r.licenses) for r in licenses.scan(df).collect()}
    for k, text, _ in docs[:10]:
        block = licenses.words(text)
        near = {n for n, t in licenses.TEMPLATES if least_differences(licenses.words(t), block) <= licenses.SLACK * len(licenses.words(t))}
        assert got[k] <= near and bool(got[k]) == bool(near), (k, got[k], near)
    assert got[101] == set() and got[102] == {"MIT"} and licenses.scan(df.limit(0)).count() == 0


def test_blocks_reach_over_lines_and_apart():
    far = " word" * (2 * licenses.reach() + 1)
    assert len(licenses.blocks(f"All rights\n# reserved.{far}\nPublic\n// domain")) == 2
    assert licenses.blocks("free range\nsoftware") == []


# --- 9


def plain_components(docs):
    sets = {}
    for i, t in docs:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = {i: i for i, _ in docs}
    for i, j in itertools.combinations(sets, 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(parent, i), find(parent, j)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(parent, i)) for i in parent}


@pytest.mark.parametrize("few,block,hot,bucket_size,fanout", [(24, 256, 4096, 1 << 21, 1024), (2, 4, 4096, 50, 1 << 20), (2, 4, 3, 100, 4)])
def test_ngram_join(spark, few, block, hot, bucket_size, fanout):
    rng, docs = random.Random(8), []
    for _ in range(14):
        base = words_of(rng, rng.randrange(3, 60), WORDS + [f"w{k}" for k in range(40)]).split()
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(30)}"
            docs.append((len(docs), " ".join(copy)))
    docs += [(len(docs) + k, t) for k, t in enumerate([None, "", " \n ", "one two", "ONE\ttwo", docs[0][1].upper()])]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.components_of(df, few=few, block=block, hot=hot, cells=1 << 14, bucket_size=bucket_size, fanout=fanout).collect()}
    assert got == plain_components(docs)


def test_ngram_join_of_nothing_and_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "q")], "doc_id long, text string")
    assert ngramjoin.components_of(df.limit(0)).count() == 0
    assert sorted(map(str, rows(ngramjoin.components_of(df), "doc_id", "n_shingles", "component_id"))) == sorted(map(str, [(1, 2, 1), (1, 2, 1), (None, 2, None), (None, 1, None)]))


def test_common_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = ngramjoin.common_counts(sets, wide=7)
    assert all(got[i][j] == want[i][j] for i in range(20) for j in range(20) if i != j)


# --- 10


def test_token_counts(spark):
    rng = random.Random(6)
    ranked = ["▁", "a", "b", "ab", "▁ab", "abb", "ba", "é", "▁b"]
    pieces = piececounts.pieces_of([p.encode() for p in ranked])
    harmonic = sum(1 / r for r in range(1, len(ranked) + 1))
    table = {p.encode(): -math.log(r * harmonic) for r, p in enumerate(ranked, 1)}

    def plain(word):
        best = [(0.0, 0)]
        for e in range(1, len(word) + 1):
            options = [(best[e - 1][0] + pieces.unknown, best[e - 1][1] + 1)] + [(best[e - k][0] + table[word[e - k : e]], best[e - k][1] + 1) for k in range(1, e + 1) if word[e - k : e] in table]
            top = max(s for s, _ in options)
            best.append(min(((s, n) for s, n in options if abs(s - top) < 1e-9), key=lambda x: x[1]))
        return best[-1][1]

    texts = [None, "", "  "] + [" ".join("".join(rng.choice("abéc") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 20))) for _ in range(30)] + ["ab" * 400]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: (r.n_tokens, r.n_words) for r in piececounts.token_counts(df, pieces).collect()}
    for i, t in enumerate(texts):
        own = (t or "").split()
        assert got[i] == (sum(plain("▁".encode() + w.encode()) for w in own), len(own)), t
    assert piececounts.token_counts(df.limit(0), pieces).count() == 0


def test_long_pre_tokens_are_not_cut(spark):
    rng = random.Random(13)
    ranked = ["▁", "a", "b", "ab", "▁ab", "abba", "ba", "é", "bé", "中文", "中", "abbaba"]
    pieces = piececounts.pieces_of([p.encode() for p in ranked])
    harmonic = sum(1 / r for r in range(1, len(ranked) + 1))
    table = {p.encode(): -math.log(r * harmonic) for r, p in enumerate(ranked, 1)}

    def plain(word):
        best = [(0.0, 0)]
        for e in range(1, len(word) + 1):
            options = [(best[e - 1][0] + pieces.unknown, best[e - 1][1] + 1)] + [(best[e - k][0] + table[word[e - k : e]], best[e - k][1] + 1) for k in range(1, min(e, 9) + 1) if word[e - k : e] in table]
            top = max(s for s, _ in options)
            best.append(min(((s, n) for s, n in options if abs(s - top) < 1e-9), key=lambda x: x[1]))
        return best[-1][1]

    words = ["".join(rng.choice("abbaé中文c") for _ in range(n)) for n in (84, 85, 260, 900)] + ["ab" * 400, "中文" * 300, "abba" * 200]
    want = [plain("▁".encode() + w.encode()) for w in words]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(99, " ".join(words))], "doc_id long, text string")
    got = dict(rows(piececounts.token_counts(df, pieces), "doc_id", "n_tokens"))
    assert got == {**dict(enumerate(want)), 99: sum(want)}
    for size in (1, 7, 100):
        assert [piececounts.long_count("▁".encode() + w.encode(), pieces, size) for w in words] == want
    assert piececounts.long_count(b"abc", piececounts.pieces_of([])) == 3


# --- odd tables

INNER = ["_found", "_names", "_logs", "_share", "_best", "_links", "_component", "_h", "class", "signs", "k1", "n", "rep", "label", "x", "c0", "bucket", "ids", "a.b", "hit_spans2"]


@pytest.mark.parametrize("name", ["pii", "langid", "neardup", "decontaminate", "bpe", "licenses", "piececounts"])
def test_columns_of_any_name_keep_their_values(spark, name):
    import public_tokenizers as P

    extra = [c for c in INNER if not (name == "neardup" and c in ("label", "x") or name == "bpe" and c == "ids")]
    text = "Mr. John Smith mailed a@b.com. Released under the MIT License."
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in extra)
    df = spark.createDataFrame([(i, t, *[f"{c}{i}" for c in extra]) for i, t in enumerate([text, text, None, ""])], schema)
    none = F.lit(None).cast("string")
    run = {
        "pii": lambda: pii.surrogate(df, "k"), "langid": lambda: langid.identify(df.withColumns({"declared": none, "host": none, "suffix": none}), langid.TextModel(["aa"], np.log(np.full((1 << 16, 2), 0.5)))),
        "neardup": lambda: neardup.link_vectors(df.withColumns({"vec_id": F.col("doc_id"), "embedding": F.array(F.lit(1.0), F.lit(2.0)), "label": F.lit(1)})),
        "decontaminate": lambda: decontaminate.scan(df, spark.createDataFrame([(1, "mit license")], "item_id long, text string")), "bpe": lambda: bpe.round_trip(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
        "licenses": lambda: licenses.scan(df), "piececounts": lambda: piececounts.token_counts(df, piececounts.pieces_of([b"a"])),
    }
    got = run[name]().collect()
    assert len(got) == 4 and all(r[c] == f"{c}{r.doc_id}" for r in got for c in extra)


def test_very_long_texts(spark):
    rng = random.Random(23)
    long = words_of(rng, 120_000, [f"w{k}" for k in range(5000)])
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short"), (3, "short")], "doc_id long, text string")
    got = sorted(rows(ngramjoin.components_of(df), "doc_id", "n_shingles", "component_id"))
    assert [(i, c) for i, _, c in got] == [(1, 1), (2, 1), (3, 3), (3, 3)] and got[1][1] - got[0][1] in (0, 1)
    scored = {r.doc_id: r for r in ctw.score(df).collect()}
    assert scored[1].n_tokens == 120_001 and scored[2].n_tokens == 120_002 and all(r.score < 0 for r in scored.values())


# --- the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(7)
    vocab = {"en": WORDS, "de": "der die und nicht ein das ist mit von auf haus wasser".split()}
    data = [(i, " ".join(rng.choice(vocab[l]) + rng.choice(["", "s", "en"]) for _ in range(40)), l, f"s{i % 2}", 0) for i, l in enumerate(["en", "de"] * 20)]
    item = " ".join(rng.choice(WORDS) + "x" for _ in range(12))
    data += [(100, data[0][1], "en", "s0", 0), (101, data[1][1] + " " + item, "de", "s1", 0), (102, data[2][1] + " mail a.b@c.example.com", "en", "s0", 0), (103, "#### %%%", "en", "s0", 0), (104, None, "en", "s0", 0), (5, data[5][1], "de", "s1", 0)]
    data = [(i, t, l, s, len(t or "")) for i, t, l, s, _ in data]
    spark.createDataFrame(data, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = sorted(r.doc_id for r in out)
    assert 100 not in ids and 101 not in ids and 103 not in ids and 104 not in ids and ids.count(5) == 1
    assert set(range(40)) - {2} <= set(ids) and all(r.lossless for r in out)
    spark.createDataFrame([], DOC).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_stages_keep_extra_columns(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "no window of this item stands anywhere in any document here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rng, extra = random.Random(8), ["_k1", "kinds", "n_entities", "items", "component_id", "_found"]
    said = [words_of(rng, 40) for _ in range(6)] + ["mail a@b.com of " + words_of(rng, 30)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), *[f"{c}{i}" for c in extra]) for i, t in enumerate(said)] + [(None,) * (5 + len(extra))], DOC + "".join(f", {c} string" for c in extra))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = Stash(spark, "t").keep(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns, name
    got = docs.collect()
    assert sorted(r.doc_id for r in got) == list(range(7)) and all(r[c] == f"{c}{r.doc_id}" for r in got for c in extra)
