"""Phrases, language and alignment against plain counterparts, and their results on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tagloom.llm import alignment, language, phrases
from tagloom.llm.queries import TOKENIZERS
from tests.llm import brute

A, B = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
CLASHING = "doc_id long, text string, lang string, source string, n string, k string, phrase string, row long, gram long, pair long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "x", "y", "z", 1, 2, 3) for i, t, lang in rows], CLASHING).repartition(3)


# --- phrases -----------------------------------------------------------------------------------------------------


def collocations(rows, least, top, percent=80):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", raw):
            words = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        dropped = {p[i : i + m] for p, a in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= percent * c[p[i : i + m]]}
        scored = []
        for p, a in found.items():
            if p not in dropped:
                score, j = min((2000000 * a // (c[p[:j]] + c[p[j:]]), j) for j in range(1, len(p)))
                scored.append((-score, -a, b" ".join(p), c[p[:j]], c[p[j:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def test_later_passes_number_only_what_they_count(monkeypatch):
    """A pass with an earlier filter spells the phrases it counts, not every word of the text; its counts are those of the larger filter less the earlier one's."""
    rng = random.Random(4)
    batch = phrases.pa.record_batch([[" ".join(f"w{rng.randrange(40)}" for _ in range(400)) for _ in range(6)] + ["Rare Pair here. rare pair", ""], ["en"] * 8], ["text", "lang"])
    block, U = phrases._block_of([batch]), phrases.U

    def held(*found):
        words = phrases.np.zeros(1 << (phrases.FILTER_BITS - 6), U)
        hashes = phrases._phrase_hash(phrases.pa.array(["en"] * len(found)), phrases.pa.array(found))
        for places in phrases.Filter.probes(hashes):
            for place in places.tolist():
                words[place >> 6] |= U(1 << (place & 63))
        return phrases.Filter(words)

    def counts(*filters):
        return {(k, n) for b in phrases._count_block(block, *filters) for k, n in zip(*(c.to_pylist() for c in b.columns))}

    many = [f"w{i}" for i in range(40)]
    before, now = held(*many), held(*many, "rare", "pair", "here", "rare pair", "pair here")
    want = counts(now, None) - counts(before, None)
    spelled, plain = [], phrases._codes
    monkeypatch.setattr(phrases, "_codes", lambda values: (spelled.append(len(values)) if phrases.pa.types.is_large_binary(values.type) else None) or plain(values))
    assert counts(now, before) == want == {("en\nrare pair", 2), ("en\npair here", 1), ("en\nrare pair here", 1)}
    assert sum(spelled) < 20 < len(block.hashes)


def test_the_full_pass_spells_only_what_its_filter_holds():
    """The border of the full pass is counted by hash; the next pass spells what that finds; over all passes each phrase is counted by its bytes once, and whole."""
    rng = random.Random(6)
    np, pa, U = phrases.np, phrases.pa, phrases.U
    rows = [(i, " ".join(f"w{rng.randrange(9)}" for _ in range(60)) + ". Rare pair", rng.choice(["de", "en"])) for i in range(8)]
    block = phrases._block_of([pa.record_batch([[r[1] for r in rows], [r[2] for r in rows]], ["text", "lang"])])
    every = Counter()
    for _, text, lang in rows:
        for piece in text.lower().split("."):
            words = piece.split()
            every.update(f"{lang}\n{' '.join(words[i : i + k])}" for k in range(1, 5) for i in range(len(words) - k + 1))
    total = {f"{lang}\n": sum(len(re.findall(r"[^. ]+", t)) for _, t, la in rows if la == lang) for lang in ("de", "en")}

    def hashes(keys):
        return phrases._phrase_hash(*(pa.array(x, pa.string()) for x in zip(*(k.split("\n") for k in sorted(keys)))))

    def held(keys):
        words = np.zeros(1 << (phrases.FILTER_BITS - 6), U)
        for places in phrases.Filter.probes(hashes(keys)):
            np.bitwise_or.at(words, places >> U(6), U(1) << (places & U(63)))
        return phrases.Filter(words)

    def counted(*how):
        kinds = {"key": [], "h": []}
        for b in phrases._count_block(block, *how):
            kinds[b.schema.names[0]].append(b)
        spelled, hashed = (phrases._merged(found).to_pylist() if found else [] for found in kinds.values())
        return {r["key"]: r["n"] for r in spelled}, {r["h"]: r["n"] for r in hashed}

    words = {k for k in every if " " not in k and not k.endswith(("rare", "w8"))}
    pairs = {k for k in every if k.count(" ") == 1 and set(words) >= {f"{k[:2]}\n{w}" for w in k[3:].split()}}
    some = {k for k in pairs if rng.random() < 0.6}
    first, border = counted(held(words | some), None, phrases.SPLIT)
    assert first == total | {k: every[k] for k in words | some}
    by_hash = dict(zip((hashes(every) & phrases.HASHED).view(np.int64).tolist(), sorted(every)))
    assert {by_hash[h]: n for h, n in border.items()}.items() <= every.items()
    missed = {by_hash[h] for h in border if border[h] >= 3 and by_hash[h].count(" ") < 3}
    assert pairs - some and missed and any(" " not in k for k in missed)
    again, none = counted(held(words | some | missed), held(words | some), phrases.AGAIN)
    assert not none and again.items() <= every.items() and missed <= set(again) and not set(again) & set(first)
    assert all(by_hash[h] not in again for h in border if by_hash[h] not in missed)
    later = {k for k in again if every[k] >= 3 and k.count(" ") < 3}
    last, none = counted(held(words | some | missed | later), held(words | some | missed), phrases.SPELL)
    assert last and not none and last.items() <= every.items() and not set(last) & (set(first) | set(again))
    assert counted(held(words), None, phrases.HASH)[0] == {}


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(3)
    idioms = ["New York", "as far as I know", "state of the ART", "über alle Maßen"]
    rows = []
    for i in range(300):
        words = [rng.choice(idioms) if rng.random() < 0.15 else f"w{int(rng.paretovariate(1)) % 60}" for _ in range(rng.randrange(1, 60))]
        rows.append((i, "".join(w + rng.choice([" ", " ", " ", "\t", ", ", ".\n", "  "]) for w in words), rng.choice(["de", "en", None, "und"])))
    rows += [(7, rows[7][1], rows[7][2])] * 40 + [(None, None, "en"), (None, "", None), (1000, "a b " * 20_000, "en"), (1001, " \t.,;", "xx"), (1002, "tie one tie two", "xx")]
    return rows


@pytest.mark.parametrize("least,one_in,top", [(30, 8, 2000), (5, 2, 10), (30, 1000, 2000)])
def test_collocations_against_brute_force(spark, spoken, monkeypatch, least, one_in, top):
    """A sample of one in a thousand proposes next to nothing, so that all must come from the passes after it."""
    frequent = phrases.frequent_phrases
    monkeypatch.setattr(phrases, "frequent_phrases", lambda docs, least: frequent(docs, least, one_in))
    got = phrases.collocations(table(spark, spoken), least, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == collocations(spoken, least, top)


def test_a_full_filter_changes_nothing(spark, spoken, monkeypatch):
    monkeypatch.setattr(phrases.Filter, "holds", lambda self, hashes: hashes == hashes)
    got = phrases.collocations(table(spark, spoken), 30, 2000)
    assert {r.phrase for r in got.collect()} <= {r[2] for r in collocations(spoken, 30, 2000)}


def test_no_documents_have_no_phrases(spark, spoken):
    assert phrases.collocations(table(spark, spoken).limit(0)).count() == 0


# --- language ----------------------------------------------------------------------------------------------------


def predictions(rows, order=4):
    def grams(raw):
        padded = [256] * order + list(raw)
        return [tuple(padded[i - order : i + 1]) for i in range(order, len(padded))]

    nodes = defaultdict(Counter)
    for i, text, lang in rows:
        if lang is not None and zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 0:
            for g in grams((text or "").encode()):
                for k in range(order + 1):
                    nodes[lang, g[order - k : order]][g[order]] += 1
    langs = sorted({r[2] for r in rows if r[2] is not None and zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 0})

    def bits(lang, g):
        paid = 0.0
        for k in range(order, -1, -1):
            node = nodes.get((lang, g[order - k : order]))
            if node:
                total = sum(node.values()) + len(node)
                if node[g[order]]:
                    return paid - math.log2(node[g[order]] / total)
                paid -= math.log2(len(node) / total)
        return paid + 8

    out = []
    for i, text, _ in rows:
        raw = (text or "").encode()
        total = {lang: sum(bits(lang, g) for g in grams(raw)) for lang in langs}
        best = min(langs, key=lambda x: (round(total[x], 6), x))
        score = 1 / sum(2 ** (-(t - total[best]) / math.sqrt(max(len(raw), 1))) for t in total.values())
        letters = any(c.isalpha() for c in text or "")
        out.append((i, best if letters else "und", score if letters else 0.0))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tongues():
    rng = random.Random(9)
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "éèêcd"}
    rows = [(i, " ".join("".join(rng.choices(letters[lang], k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 30))), lang) for i in range(90) for lang in [rng.choice(list(letters))]]
    return rows + [(5, rows[5][1], rows[5][2]), (None, None, "aa"), (None, "", None), (200, "1234 !?", "bb"), (201, "zzz ÿ", None), (202, "abc" * 3000, None)]


@pytest.mark.parametrize("hot_bytes", [1 << 25, 4000, 0])
def test_language_against_brute_force(spark, tongues, hot_bytes):
    docs = table(spark, tongues)
    got = language.predict(docs, language.train(docs), hot_bytes)
    assert got.columns == ["doc_id", "lang_pred", "score"]
    found, wanted = sorted((tuple(r) for r in got.collect()), key=repr), predictions(tongues)
    assert [r[:2] for r in found] == [r[:2] for r in wanted]
    assert [r[2] for r in found] == pytest.approx([r[2] for r in wanted], abs=1e-5)


def test_no_language_is_learned_from_nothing(spark, tongues):
    docs = table(spark, tongues).withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language.predict(docs, language.train(docs)).collect()} == {("und", 0.0)}
    full = table(spark, tongues)
    assert language.predict(full.limit(0), language.train(full)).count() == 0
    assert language.predict(full.limit(0), language.train(full.limit(0))).count() == 0


# --- alignment ---------------------------------------------------------------------------------------------------


def alignments(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok, b_tok = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
    names = {i: t for t, i in a_tok.get_vocab().items()}

    def b_bytes(i):
        return bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()

    found, links = [], Counter()
    for i, text in rows:
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        sides = [[bytes(letters[c] for c in names[t]) for t in a], [b_bytes(t) for t in b]]
        if not text or any(b"".join(s) != (" " + text).encode() for s in sides):
            found.append((i, 0, 0, 0, [], ""))
            continue
        ends = [[sum(map(len, s[: k + 1])) for k in range(len(s))] if len(s) < 300 else list(_running(s)) for s in sides]
        place = [{e: k + 1 for k, e in enumerate(x)} for x in ends]
        groups, p, q = [], 0, 0
        for e in sorted(place[0].keys() & place[1].keys()):
            groups.append(",".join(map(str, a[p : place[0][e]])) + "|" + ",".join(map(str, b[q : place[1][e]])))
            p, q = place[0][e], place[1][e]
        own, j = [], 0
        for k, e in enumerate(ends[0]):
            while ends[1][j] <= e - len(sides[0][k]):
                j += 1
            m = j
            while m < len(b) and ends[1][m] - len(sides[1][m]) < e:
                own.append((a[k], b[m]))
                m += 1
        links.update(own)
        found.append((i, len(a), len(b), len(groups), own, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (_, b), n in links.items():
        top[b] = max(top[b], n)
    return sorted(((i, x, y, g, len(own), sum(links[p] == top[p[1]] for p in own), sum(links[p] for p in own), h) for i, x, y, g, own, h in found), key=repr)


def _running(parts):
    total = 0
    for p in parts:
        total += len(p)
        yield total


@pytest.mark.parametrize("piece,span,hot", [(1 << 15, 1 << 13, 1 << 20), (200, 40, 300), (64, 16, 0)])
def test_alignment_against_brute_force(spark, piece, span, hot):
    rows = [(i, brute.prose(40 + 9 * i, i)) for i in range(12)] + [
        (None, None), (None, ""), (3, brute.prose(67, 3)), (3, brute.prose(67, 3)), (20, "a<|endoftext|> b <s> </s><unk>"), (21, "x▁y"), (22, "  two  blanks \t tab\n\n new"), (23, "日本語のテキスト🙂é" * 40),
        (24, "word " * 9000), (25, "x▁y " * 3000), (26, "日本語" * 3000), (27, "\x00 nul"), (28, "a" * 5000), (29, " " * 3000 + "a"), (30, "It's 123 dogs' ½ ٣٤ ﬁ" * 100),
    ]
    got = alignment.align(table(spark, [(i, t, "en") for i, t in rows]), A, B, piece, span, hot)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == alignments(rows)
    assert alignment.align(table(spark, [(1, "x", "en")]).limit(0), A, B).count() == 0


def test_fragments_compose_in_any_order():
    enc = alignment.Encoders(A, B)
    a, b = next(enc.encode([brute.prose(120, 1)]))
    a_ends, b_ends = enc.a_length[a].cumsum(), enc.b_length[b].cumsum()
    for span in (7, 23, 64):
        parts = []
        for r in range(int(a_ends[-1]) // span + 1):
            i, p = (a_ends > r * span).argmax() if (a_ends > r * span).any() else len(a), (a_ends <= (r + 1) * span).sum()
            j, q = (b_ends > r * span).argmax() if (b_ends > r * span).any() else len(b), (b_ends <= (r + 1) * span).sum()
            parts.append(alignment.fragment_of(a[i:p], a_ends[i:p], b[j:q], b_ends[j:q])[0])
        left, right = parts[0], parts[-1]
        for x in parts[1:]:
            left = alignment.compose(left, x)[0]
        for x in reversed(parts[:-1]):
            right = alignment.compose(x, right)[0]
        assert left.closed == right.closed and all(list(x) == list(y) for x, y in zip((*left.head, *left.tail), (*right.head, *right.tail)))


def test_both_libraries_of_the_byte_level_vocabulary_agree(spark):
    from tokenizers import Tokenizer

    enc, a_tok = alignment.Encoders(A, B), Tokenizer.from_file(A)
    a_tok.encode_special_tokens = True
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["".join(f"a{chr(c)} {chr(c)}b1{chr(c)}" for c in range(at, at + 512) if not 0xD800 <= c < 0xE000) for at in range(1, 0x3200, 512)]
    for text in texts:
        assert enc._a.encode_ordinary(" " + text) == a_tok.encode(" " + text, add_special_tokens=False).ids
