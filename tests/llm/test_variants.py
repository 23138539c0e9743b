"""Spelling variants, language ID and conversation repair against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from teleskein.llm import conversation, langid, spelling
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(brute.odd_rows(), brute.ODD_SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], brute.ODD_SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def crc(text: str) -> int:
    return zlib.crc32(text.encode())


# --- spelling ---


def mistyped(rows: list[tuple]) -> Counter:
    found: Counter = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc(f"{'' if doc is None else doc}:{run}")
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return Counter({w: n for w, n in found.items() if len(w) >= 5 and n >= 3})


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(words: dict[str, int]) -> list[tuple]:
    """All pairs of words, but for those whose lengths rule them out."""
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    near = {w: [x for n in (len(w) - 1, len(w), len(w) + 1) for x in by_length[n] if one_apart(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def variant_rows(df) -> list[tuple]:
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def test_variants(odd, empty, docs):
    for table in (odd, docs.filter("doc_id < 60")):
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        assert variant_rows(spelling.variants(table)) == brute_variants(mistyped(rows))
    assert spelling.variants(empty).collect() == []


def test_variants_of_few_letters(spark, monkeypatch):
    """Runs of one letter, every length, prefixes of one another, chains of forms, several
    stretches that share nodes; a long word and its typo."""
    monkeypatch.setattr(spelling, "STRETCH", 40)
    rng = random.Random(4)
    words = {"".join(rng.choices("abß", k=rng.randrange(5, 9))): rng.choice([3, 4, 6, 12, 24, 50]) for _ in range(500)}
    words |= {"a" * k: 2**k for k in range(5, 40)}
    long = "".join(rng.choices("xyz", k=30_000))
    words |= {long: 9, long[:20_000] + long[20_001:]: 4, long[:15_000] + "é" + long[15_001:]: 18, long + "x": 3}
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    assert variant_rows(spelling.grouped(table)) == brute_variants(words)


def test_full_group_of_an_alphabet(spark):
    letters = [chr(c) for c in itertools.chain(range(97, 123), range(0xC0, 0x100))]
    words = {f"wo{c}rt": 3 + k for k, c in enumerate(letters)} | {"wort" + "e": 3, "wort": 1000} | {f"wort{c}": 4 for c in letters}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert variant_rows(spelling.grouped(table)) == brute_variants(words)


def test_shared_length():
    rng = random.Random(2)
    for _ in range(300):
        a = "".join(rng.choices("ab", k=rng.randrange(0, 300)))
        b = a[: rng.randrange(0, len(a) + 1)] + "".join(rng.choices("ab", k=rng.randrange(0, 9)))
        want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert spelling.shared_length(a, b) == want == spelling._halved(a, b)


# --- language ID ---


def test_network_gradients():
    """Analytic against numeric, on a small network."""
    rng = np.random.default_rng(3)
    net = langid.Network.fresh(["a", "b", "c"], rng)
    for p in net.parameters():
        p += rng.normal(0, 0.1, p.shape).astype(np.float32)
    windows = rng.integers(0, 5, (6, 20)).astype(np.uint8)
    wanted = rng.integers(0, 3, 6)

    def loss() -> float:
        return float(-np.log(net.probabilities(windows)[np.arange(6), wanted].astype(float)).mean())

    for p, g in zip(net.parameters(), net.gradients(windows, wanted), strict=True):
        for at in np.argsort(-np.abs(g).ravel())[:4]:
            kept = p.flat[at]
            p.flat[at] = kept + 2e-3
            above = loss()
            p.flat[at] = kept - 2e-3
            below = loss()
            p.flat[at] = kept
            assert abs((above - below) / 4e-3 - g.flat[at]) < 3e-3


def plain_probabilities(net: langid.Network, text: bytes) -> np.ndarray:
    """One window after the other, one place after the other."""
    size, windows = langid.WINDOW, []
    for at in range(0, max(1, len(text)), size):
        begin = max(0, min(at, len(text) - size))
        windows.append(text[begin : begin + size].ljust(size, b"\0"))
    out = []
    for w in windows:
        pooled = []
        for table in net.tables:
            pooled += list(np.max([sum(table[k][w[i + k]] for k in range(len(table))) for i in range(size - len(table) + 1)], axis=0))
        logits = np.maximum(np.array(pooled) + net.bias, 0) @ net.out + net.out_bias
        out.append(np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum())
    return np.mean(out, axis=0)


def test_whole_texts_are_judged():
    net = langid.Network.fresh(["x", "y", "z"], np.random.default_rng(5))
    texts = ["", "a", "é" * 127, "b" * 255, "c" * 256, "ab" * 400, "zz" * 128 + "end of it", None]
    column = pa.array(["skipped", *texts], pa.string()).slice(1)
    got = langid.judged(net, column, block=3)
    want = [plain_probabilities(net, (t or "").encode()) for t in texts]
    assert np.abs(got - np.array(want)).max() < 1e-5
    assert len(langid.judged(net, pa.array([], pa.string()))) == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.languages(docs, rows=300).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (crc(str(r["doc_id"])) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_learns_from_text_alone(spark, docs):
    """Labels of held-out rows and null labels do not matter, nor does source; reruns agree."""
    other = docs.selectExpr("doc_id", "text", f"CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 'xx' ELSE lang END AS lang", "'s' AS source")
    a = sorted(map(tuple, langid.languages(docs, rows=60).collect()))
    b = sorted(map(tuple, langid.languages(other.repartition(5), rows=60).collect()))
    assert a == b and not any(r[2] == "xx" for r in b)


def test_language_odd_rows(odd, empty, spark):
    rows = langid.languages(odd, rows=50).collect()
    assert len(rows) == odd.count()
    texts = defaultdict(list)
    for d, t, *_ in brute.odd_rows():
        texts[d].append(t)
    for r in rows:
        if len(texts[r["doc_id"]]) == 1:
            text = texts[r["doc_id"]][0]
            assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text or "")))
    assert {r["score"] for r in rows if r["lang_pred"] == "en"} == {1.0}
    assert langid.languages(empty).collect() == []
    unlabelled = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in langid.languages(unlabelled).collect()} == {("und", 0.0)}


# --- conversations ---

NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows: list[tuple]) -> dict:
    talks: dict = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = " " if role is None else role, " " if text is None else text
        hit = crc(key) % 20
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        talks[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(hit, 1)
    return talks


def in_order(rows: list[tuple]) -> list[tuple]:
    def key(row: tuple) -> tuple:
        turn, role, text = row
        return turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()

    return sorted(rows, key=key)


def faults(rows: list[tuple]) -> list[str]:
    out, seen = [], set()
    for _, role, text in rows:
        shown = NOT_SPACE.findall(text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_repair(rows: list[tuple], found: list[str]) -> tuple:
    """Least (cost, audit, output) row by row, for every output that can still become legal."""

    def spread(best: dict) -> dict:
        for _ in range(4):
            for state, (cost, audit, out) in list(best.items()):
                for role, step in (("user", {"": "u", "s": "u", "a": "u"}), ("assistant", {"u": "a"})):
                    if state in step:
                        new = (cost + 3, audit + "I", [*out, (role, "")])
                        if step[state] not in best or new[:2] < best[step[state]][:2]:
                            best[step[state]] = new
        return best

    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", [])}
    for (_, role, text), fault in zip(rows, found, strict=True):
        after: dict = {}
        for state, (cost, audit, out) in spread(best).items():
            options = [(state, cost + 4, audit + "D", out)]
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault else 0
                for name, price, edit in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                    if name[:1] and name[0] in follows[state]:
                        options.append((name[0], cost + price + extra, audit + edit, [*out, (name, text)]))
            for s, *rest in options:
                if s not in after or tuple(rest[:2]) < after[s][:2]:
                    after[s] = tuple(rest)
        best = after
    best = spread(best)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def brute_repaired(rows: list[tuple]) -> list[tuple]:
    result = []
    for conv, talk in damage(rows).items():
        talk = in_order(talk)
        found = faults(talk)
        turns = [t for t, *_ in talk if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in talk]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, out = plain_repair(talk, found)
        text = "\n".join(f"{r}:{t}" for r, t in out)
        counts = Counter(found)
        result.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, brute.sha256(text.encode())))
    return sorted(result, key=repr)


def repaired_rows(df) -> list[tuple]:
    names = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


TALK = "conv_id long, turn long, role string, text string"


def talk_rows(seed: int = 1, talks: int = 300) -> list[tuple]:
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "under", "speaker"]
    texts = ["Yes.", "No", "Why?", "", " \n", None, "odd. ", "Ja!\t", "x"]
    rows = [(None, None, None, None), (None, None, None, None), (7, None, "user", "null turn first."), (7, None, "user", "null turn first.")]
    for conv in range(talks):
        at = 0
        for _ in range(rng.randrange(1, 9)):
            at += rng.choice([0, 1, 1, 1, 1, 1, 3])
            rows.append((conv, rng.choice([at, at, at, at, at, None]), rng.choices(roles, [8, 8, 3, 1, 1, 1, 1, 1])[0], rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
    rows += [(1000, t, "au"[t % 2] * 3, f"turn {t}" + "." * (t % 3 > 0)) for t in range(3000)]
    rows += [(1001, t, "user", "again and again.") for t in range(700)] + [(1002, 5, "assistant", "the same row!")] * 700
    return rows


def test_conversations_equal_plain_repair(spark, monkeypatch):
    monkeypatch.setattr(conversation, "SEGMENT", 37)
    rows = talk_rows()
    df = spark.createDataFrame(rows, TALK).repartition(6).selectExpr("*", "'clash' AS conv", "1 AS at")
    assert repaired_rows(conversation.repaired(df)) == brute_repaired(rows)


def test_conversations_of_the_tables(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert repaired_rows(conversation.repaired(df)) == brute_repaired([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()])
    assert conversation.repaired(df.limit(0)).collect() == []


def test_plain_repair_is_least():
    """Against every edit script of short conversations."""

    def every(rows: list[tuple], found: list[str]):
        legal = re.compile("(s?(ua)+)?")
        edits = [["D"] if f in ("blank", "duplicate") else ["K", "Ru", "Ra", "D"] for f in found]
        gaps = list(itertools.chain.from_iterable(itertools.product(("u", "a"), repeat=n) for n in range(3)))
        for choice in itertools.product(*edits):
            for put in itertools.product(gaps, repeat=len(rows) + 1):
                cost, audit, out = 0, "", ""
                for k, made in enumerate(put):
                    cost, audit, out = cost + 3 * len(made), audit + "I" * len(made), out + "".join(made)
                    if k < len(rows):
                        edit = choice[k]
                        cost += {"K": 0, "R": 3, "D": 4}[edit[0]] + (3 if found[k] == "truncated" and edit != "D" else 0)
                        audit += edit[0]
                        out += {"K": rows[k][1][:1], "D": ""}.get(edit[0], edit[1:])
                if legal.fullmatch(out):
                    yield cost, audit

    rng = random.Random(9)
    for _ in range(25):
        rows = [(k, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", f"{k}."])) for k in range(rng.randrange(0, 4))]
        found = faults(rows)
        assert plain_repair(rows, found)[:2] == min(every(rows, found))


def test_rules_never_change_a_result(spark):
    rng = random.Random(6)
    symbols = ["".join(rng.choices("abcdefghD", [9, 3, 9, 2, 9, 2, 1, 1, 2], k=rng.choice([0, 1, 5, 300]))) for _ in range(60)]
    symbols += ["ce" * 200, "D" * 77]
    sequences = spark.createDataFrame([(s, 3) for s in symbols if s], "symbols string, weight long").repartition(3)
    grammar = conversation.learned(sequences)
    assert len(grammar.rules) > 20
    plain = conversation.Grammar()
    for s in symbols:
        chain = conversation.Chain()
        for c in s:
            chain.add(plain.matrices[c])
        assert conversation.ended(grammar.matrix(s)) == conversation.ended(chain.total()) == conversation.ended(plain.matrix(s))
        assert len(conversation.compressed(s, grammar.rules)) <= len(s)


def test_ropes():
    rng = random.Random(8)
    for _ in range(200):
        a = b = ""
        plain_a = plain_b = ""
        shared = "x" * 70
        for _ in range(rng.randrange(1, 12)):
            part = rng.choice(["K", "D" * 80, shared, "R"])
            other = part if rng.random() < 0.9 else "K"
            a, b = conversation.joined(a, part), conversation.joined(b, other)
            plain_a, plain_b = plain_a + part, plain_b + other
        assert conversation.flat(a) == plain_a and conversation.less(a, b) == (plain_a < plain_b)
