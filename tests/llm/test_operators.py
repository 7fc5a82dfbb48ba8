import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_plain import components, shingled, words
from pyspark.sql import functions as F

from plotwise.llm import chat, fingerprint, minhash, mixing, quality_cnn, quality_rules, sentencepiece, substrings, token_counts, toxicity
from plotwise.llm.text import span_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Wort für Wort " * 20_000
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", None, 3), (4, "one", "en", None, 3), (5, LONG, "de", "b", len(LONG)), (None, "no id here", "en", "b", 10), (7, "tie tie tie tie", "en", "a", 15)]
ADDED = ["size", "target", "taken", "epoch", "ids", "n_ids", "n_removed", "score", "fingerprint", "class", "rep", "key", "at", "hash"]


def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns that clash with what operators add."""
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit("own") for c in ADDED})


def empty(spark):
    return odd(spark).where("false")


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="module")
def bodies(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}


# Mixing


def test_mix_meets_targets_and_is_stable(spark, documents):
    plan = mixing.mix_plan(documents).select("doc_id", "size", "source", "source_size", "target", "taken").cache()
    assert sorted(plan.collect()) == sorted(mixing.mix_plan(documents.repartition(5)).select(*plan.columns).collect())
    by = plan.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest"), F.first("source_size").alias("s"))
    largest = plan.agg(F.max("size")).first()[0]
    for r in by.collect():
        assert abs(r.taken - r.target) <= largest + 1e-6 and r.target <= 3 * r.s + 1e-6
    assert plan.where("taken > 3 * size").count() == 0
    total = plan.groupBy().sum("size").first()[0]
    assert math.isclose(by.groupBy().sum("target").first()[0], total, rel_tol=1e-9)


def test_mix_rows_follow_the_plan(spark, documents):
    plan = dict(mixing.mix_plan(documents).where("epochs > 0").select("doc_id", "epochs").collect())
    mixed = mixing.mix_sources(documents)
    got = mixed.select("doc_id", "virtual_finish").collect()
    assert Counter(r.doc_id for r in got) == plan
    finish = [r.virtual_finish for r in got]
    assert finish == sorted(finish)


def test_mix_caps_and_reshares(spark):
    rows = [(i, "w " * 10, "x", s, 0) for i, s in enumerate(["a"] * 2 + ["b"] * 50)]
    weights = spark.createDataFrame([("a", 9.0), ("b", 1.0)], "source string, weight double")
    by = {r.source: (r.target, r.taken) for r in mixing.mix_plan(spark.createDataFrame(rows, DOCS), weights).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    assert by == {"a": (60.0, 60), "b": (460.0, 460)}


@pytest.mark.parametrize("share", [0.3, 1.0, 2.5, 3.0])
def test_mix_against_a_plain_queue(spark, documents, bodies, share):
    source = {r.doc_id: r.source for r in documents.collect()}
    sizes = {i: len(words(t)) for i, t in bodies.items()}
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(set(source.values()), key=lambda s: (s is None, s or "")))}
    total, queue = Counter(), []
    for i, n in sizes.items():
        total[source[i]] += n
    for s, w in weight.items():
        served = 0
        for epoch in range(3):
            for i in sorted((i for i in sizes if source[i] == s), key=lambda i: hashlib.md5(f"mix|{i}".encode()).hexdigest()):
                served += sizes[i]
                queue.append((served / w, "n" if s is None else f"s{s}", epoch, i))
    served, taken = 0, Counter()
    for _, _, _, i in sorted(q for q in queue if sizes[q[3]]):
        if 2 * served + sizes[i] <= 2 * share * sum(sizes.values()):
            taken[i] += sizes[i]
        served += sizes[i]
    got = mixing.mix_plan(documents, budget_share=share, per_range=2, ranges=8)
    assert {r.doc_id: r.taken for r in got.collect()} == {i: taken[i] for i in sizes}


# Fingerprints


def test_edit_distance_and_likeness():
    rng = random.Random(0)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        assert fingerprint.edit_distance(a, b) == row[-1]
    assert fingerprint.likeness("3::", "3::") == 1.0 and fingerprint.likeness("3::", "3:abcdef:abc") == 0.0


def test_fingerprints_against_plain_version(spark, documents, bodies):
    order = sorted(bodies)
    got = {r.doc_id: r for r in fingerprint.fingerprint_edits(documents).collect()}
    assert sorted(got) == order
    for k, doc_id in enumerate(order):
        text, after = bodies[doc_id], bodies[order[(k + 1) % len(order)]]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = got[doc_id]
        marks = [fingerprint.fingerprint(x.encode()) for x in (text, edited, after)]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), marks[0], marks[1])
        assert (r.near_edited, r.near_next) == (fingerprint.likeness(marks[0], marks[1]), fingerprint.likeness(marks[0], marks[2]))
    values = list(got.values())
    assert np.mean([r.near_edited for r in values]) > 0.5 > 0.2 > np.mean([r.near_next for r in values])


def plain_fingerprint(data):
    """Chunk by chunk, trying one block size after the other; only the table of byte values and the hash of a chunk are the operator's."""

    def chunks(size):
        out, start = [], 0
        for i in range(len(data)):
            roll = sum((int(fingerprint._BYTE[data[i - k]]) >> 32) * 31 ** (2 * k + 1) for k in range(min(7, i + 1))) % 2**32
            if (roll ^ (roll >> 15)) % size == size - 1:
                out.append(data[start : i + 1])
                start = i + 1
        return [*out, data[start:]] if start < len(data) else out

    def sign(size):
        return "".join(fingerprint.DIGITS.decode()[int(span_hashes(np.frombuffer(c, np.uint8), np.array([0]), np.array([len(c)]))[0]) >> 58] for c in chunks(size))

    size = 3
    while len(chunks(size)) > 64:
        size *= 2
    return f"{size}:{sign(size)}:{sign(2 * size)}"


def test_fingerprints_chunk_by_chunk():
    rng = random.Random(6)
    for n in (0, 1, 2, 6, 7, 8, 30, 190, 191, 192, 193, 400, 1500):
        for letters in ("a", "ab", "abcdefghij \u00e9\u4e2d\n"):
            data = "".join(rng.choice(letters) for _ in range(n)).encode()
            assert fingerprint.fingerprint(data) == plain_fingerprint(data)


def test_fingerprint_block_size_and_locality():
    rng = random.Random(1)
    text = " ".join(str(rng.random()) for _ in range(3000))
    size, one, two = fingerprint.fingerprint(text.encode()).split(":")
    assert 16 <= len(one) <= 64 and len(two) < len(one) and int(size) > 3
    changed = text[:20_000] + "X" + text[20_000:]
    assert 0.9 < fingerprint.likeness(fingerprint.fingerprint(text.encode()), fingerprint.fingerprint(changed.encode())) < 1


# MinHash


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_against_all_pairs(spark, documents, bodies, width):
    sets = {i: shingled(t, width) for i, t in bodies.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(documents, width=width).collect()}
    want = components(sets)
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


@pytest.mark.parametrize("block", [1024, 16, 3])
def test_near_duplicates_of_a_drifting_group(spark, monkeypatch, block):
    monkeypatch.setattr(minhash._across, "__defaults__", (block, 8 << 20))
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    texts = []
    for k in range(120):  # copies of one text with more and more edits: some are near the base only, some to each other, some to none
        ws = list(base)
        for _ in range(k // 12):
            ws[rng.randrange(len(ws))] = f"e{rng.randint(0, 10**6)}"
        texts.append(" ".join(ws))
    sets = {i: shingled(t, 4) for i, t in enumerate(texts)}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, texts), width=4).collect()}
    assert got == components(sets)


def test_least_matches_is_a_posterior_bound():
    for n in (32, 336):
        m = minhash.least_matches(n, 0.8, 1e-6)
        draws = np.random.default_rng(0).binomial(n, 0.8, 200_000)
        assert 0 < m < 0.8 * n and (draws < m).mean() < 1e-4


# SentencePiece and token counts


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.load()


def fuzz(n, seed=1):
    rng = random.Random(seed)
    letters = "aabcdeth  ▁\n\t.,#<é☃漢字\U0001f600XYZ123 ingtionthe"
    for k in range(n):
        x = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        yield " " * rng.randint(0, 40) + x + " " * rng.randint(0, 5) if k % 5 == 0 else x


def test_encoding_equals_the_library(pieces, bodies):
    import sentencepiece as library

    processor = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    for text in [*bodies.values(), *fuzz(1500)]:
        ids = pieces.encode(text)
        assert ids.tolist() == processor.encode(text)
        assert pieces.decode(ids) == text.replace("▁", " ")


def test_encoding_round_trips_in_spark(spark, documents):
    encoded = sentencepiece.encode(documents, with_columns=True)
    assert encoded.where("not round_trip or n_ids <> size(ids)").count() == 0
    back = sentencepiece.decode(encoded, column="back")
    assert back.where("back <> text").count() == 0


def test_counts_equal_the_library(pieces, bodies):
    import sentencepiece as library
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(sentencepiece.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1  # the same pieces and scores, read as a unigram model
    processor = library.SentencePieceProcessor(model_proto=model.SerializeToString())
    counter = token_counts.Counter(pieces)
    for text in [*bodies.values(), *fuzz(1500), *fuzz(500, 2)]:
        assert counter.count(text)[0] == len(processor.encode(text))


def test_counts_equal_the_library_whatever_the_scores(pieces, bodies):
    import sentencepiece as library
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(sentencepiece.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    rng = random.Random(6)
    for p in model.pieces:  # many ties, and fractions that single precision can't add exactly
        p.score = -rng.choice([1.0, 2.0, 2.5, 3.3, 4.7]) * len(p.piece) ** 0.5
    processor = library.SentencePieceProcessor(model_proto=model.SerializeToString())
    counter = token_counts.Counter(sentencepiece.Pieces([p.piece for p in model.pieces], [p.score for p in model.pieces], [p.type for p in model.pieces], 1))
    for text in [*bodies.values(), *fuzz(500)]:
        assert counter.count(text)[0] == len(processor.encode(text))


def test_unspaced_text_takes_linear_time(pieces):
    draw = random.Random(4)
    for letters in ("的一是不了人我在有他这中大来上国个到说们", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefABCDEF+/"):
        text = "".join(draw.choices(letters, k=400_000))
        counter = token_counts.Counter(pieces)
        began = time.monotonic()
        few = counter.count(text[:40_000])
        middle = time.monotonic()
        many = counter.count(text)
        assert time.monotonic() - middle < 40 * max(middle - began, 0.05)
        assert 0 < 9 * few[0] < many[0] < 11 * few[0]


def test_counts_against_plain_viterbi(pieces):
    plain = sentencepiece.Pieces(pieces.names, [max(s, -40_000.0) for s in pieces.scores], pieces.kinds, pieces.kind)  # added exactly
    counter = token_counts.Counter(plain)
    known = {p: s for p, s, k in zip(plain.names, plain.scores, plain.kinds, strict=True) if k == 1}
    for text in ["the thing", "naïve ☃ test", "  two  spaces "]:
        full = "▁" + text.replace(" ", "▁")
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(full)
        for end in range(1, len(full) + 1):
            for start in range(end):
                part = full[start:end]
                score, n = (known[part], 1) if part in known else (counter.lost, len(part.encode())) if len(part) == 1 else (-math.inf, 0)
                if best[start][0] + score > best[end][0]:
                    best[end] = best[start][0] + score, best[start][1] + n
        assert counter.count(text) == (best[-1][1], best[-1][0])


# Quality rules and substrings


def test_base_counts_against_plain_version(spark, documents, bodies):
    got = {r.doc_id: r for r in quality_rules.apply_rules(documents).collect()}
    for i, text in bodies.items():
        ws = words(text)
        windows = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
        twice = {w for w, n in Counter(windows).items() if n > 1}
        repeated = {k + j for k, w in enumerate(windows) if w in twice for j in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        failed = len(ws) < 50 or 100 * len(repeated) > 50 * len(ws)
        r = got[i]
        want = (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.kept and failed)


def test_line_rules():
    good = "This is a long line of plain prose that goes on for well over a dozen words and ends properly."
    text = "\n".join([good, "Home | About us | Contact", "Accept all cookies to go on.", "### $$$ *** %%%", good, "short heading"])
    out = quality_rules.clean(np.frombuffer(text.encode(), np.uint8), quality_rules.Rules(min_words=10, repeat_percent=100))
    assert out["cleaned"] == good + "\n" + good + "\n" and out["kept"] and out["n_failed_lines"] == 4
    junk = "\n".join(["Home | About us | Contact | Menu"] * 30)
    assert not quality_rules.clean(np.frombuffer(junk.encode(), np.uint8), quality_rules.Rules(min_words=10, repeat_percent=100))["kept"]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def test_repeated_passages_go_and_clean_text_stays(spark):
    rng = random.Random(2)
    passage = prose(rng, 70)
    texts = [prose(rng, 120) for _ in range(30)]
    for k in (3, 11, 17):
        texts[k] = texts[k][:300] + " " + passage + " " + texts[k][300:]
    texts[20] = passage.replace(" ", "  ")
    out = {r.doc_id: r for r in substrings.dedup_substrings(docs(spark, texts)).collect()}
    for k, text in enumerate(texts):
        if k in (11, 17, 20):
            left = words(out[k].text)
            grams = {tuple(left[i : i + 50]) for i in range(len(left) - 49)}
            ws = words(passage)
            assert not grams & {tuple(ws[i : i + 50]) for i in range(len(ws) - 49)} and out[k].n_removed > 0
        else:
            assert out[k].text == text and out[k].n_removed == 0


def test_no_fifty_word_passage_is_left_twice(spark, documents):
    seen, left = set(), 0
    for r in substrings.dedup_substrings(documents).collect():
        ws = words(r.text or "")
        grams = {tuple(ws[k : k + 50]) for k in range(len(ws) - 49)}
        left += bool(grams & seen)
        seen |= grams
    assert left <= 0.01 * documents.count()  # passages whose whole sentences have fewer than 25 words


def plain_sentences(text, long=25):
    """(words, where it begins) of each sentence, by regular expressions; cuts of very long ones by the hash of a word alone."""
    said, at, found = [], [], list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    for k, m in enumerate(found):
        at.append(m)
        gap = text[m.end() : found[k + 1].start()] if k + 1 < len(found) else "\n"
        if re.search(r"[.!?][\"')\]]{0,2}$", m[0]) or "\n" in gap:
            said.append(at)
            at = []
    out = []
    for s in said:
        part = []
        for m in s:
            part.append(m)
            word = np.frombuffer(m[0].encode(), np.uint8)
            if m is s[-1] or (len(s) > long and int(span_hashes(word, np.array([0]), np.array([len(word)]))[0]) >> 62 == 0):
                out.append((tuple(x[0] for x in part), part[0].start()))
                part = []
    return out


def test_substrings_against_plain_version(spark, documents, bodies):
    first, want = {}, {}
    for i in sorted(bodies):
        text = bodies[i]
        said = plain_sentences(text)
        drop = [False] * len(said)
        for k in range(len(said)):
            end = k + 2
            while end < len(said) and sum(len(s) for s, _ in said[k:end]) < 25:
                end += 1
            if end <= len(said) and sum(len(s) for s, _ in said[k:end]) >= 25 and first.setdefault(tuple(s for s, _ in said[k:end]), (i, k)) != (i, k):
                drop[k:end] = [True] * (end - k)
        bounds = [0, *(b for _, b in said[1:]), len(text)]
        want[i] = (sum(drop), "".join(text[a:b] for a, b, d in zip(bounds, bounds[1:], drop, strict=False) if not d) if any(drop) else text)
    assert {r.doc_id: (r.n_removed, r.text or "") for r in substrings.dedup_substrings(documents).collect()} == want


# Chat


def test_turns_round_trip():
    rng = random.Random(3)
    for _ in range(500):
        turns = [("".join(rng.choice("ab\\#<:> \n/") for _ in range(rng.randint(0, 6))), "".join(rng.choice("x\\#</turn> :\n") for _ in range(rng.randint(0, 20)))) for _ in range(3)]
        text = "".join(chat.format_turn(r, t)[0] for r, t in turns)
        assert [(r, t) for r, t, _, _ in chat.parse(text)] == turns
    assert chat.parse(chat.format_turn("user", "\\### Assistant: </turn> ok")[0])[0][1] == "\\### Assistant: </turn> ok"


def test_reply_trees(spark):
    rows = [(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 1.0, "assistant", "good"), (1, 3, 1, 0.0, "assistant", "bad"), (1, 4, 2, 1.0, "user", "more"), (1, 5, 4, 0.0, "assistant", "end"), (2, 1, 9, None, None, None), (3, 1, 2, 0.0, "user", "loop"), (3, 2, 1, 0.0, "user", "loop")]
    tree = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, score double, role string, text string")
    paths = defaultdict(list)
    for r in chat.reply_paths(tree).orderBy("depth").collect():
        paths[r.conv_id, r.leaf_id].append(r.msg_id)
    assert dict(paths) == {(1, 5): [1, 2, 4, 5], (1, 3): [1, 3], (2, 1): [1]}
    best = {r.conv_id: r for r in chat.format_trees(tree).collect()}
    assert [t for _, t, _, _ in chat.parse(best[1].formatted)] == ["q", "good", "more", "end"] and chat.parse(best[2].formatted)[0][:2] == ("", "")
    assert [chat.unescape(best[1].formatted[s.start : s.end]) for s in best[1].loss_spans] == ["good", "end"]
    assert chat.format_trees(tree, branches=None).count() == 3
    assert chat.format_trees(tree.where("false")).count() == 0


def test_repeated_messages_and_cycles(spark):
    kinds = "conv_id long, msg_id long, parent_id long, score double, role string, text string"
    rows = [(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 0.0, "assistant", "a"), (1, 2, 1, 0.0, "assistant", "a"), (1, 2, 1, 0.0, "assistant", "b"), (1, 3, 2, None, "user", "z"), (None, None, None, None, None, None), (2, 1, 2, 0.0, "x", "loop"), (2, 2, 1, 0.0, "x", "loop"), (2, 3, 2, 0.0, "x", "below"), (2, 4, None, 0.0, "x", "free")]
    extra = spark.createDataFrame(rows, kinds).withColumns({c: F.lit("own") for c in ("leaf_id", "rank", "depth", "up", "m", "formatted")})
    got = {r.conv_id: [t for _, t, _, _ in chat.parse(r.formatted)] for r in chat.format_trees(extra, branches=None).collect()}
    assert got == {1: ["q", "a", "z"], None: [""], 2: ["free"]}


def test_long_chains_take_few_joins(spark):
    n = 300
    chain = spark.createDataFrame([(None, k, "user" if k % 2 else None, None if k == 7 else f"t{k}") for k in range(n)], "conv_id long, turn long, role string, text string")
    r = chat.digests(chat.format_trees(chat.chains(chain))).first()
    turns = "".join(f"{'user' if k % 2 else ''}\n{'' if k == 7 else f't{k}'}\n" for k in range(n))
    assert (r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars) == (None, n, hashlib.sha256(turns.encode()).hexdigest(), 0)


# Classifiers


def accuracy(scored, labels, label):
    held = scored.where("held_out").join(labels.where(F.col(label).isNotNull()), "doc_id").select("score", "predicted", label).toPandas()
    rank = held.score.rank()
    n1, n0 = (held[label] == 1).sum(), (held[label] == 0).sum()
    return (held.predicted == held[label]).mean(), (rank[held[label] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.fixture(scope="module")
def larger(spark):
    return tuple(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))


def test_quality_on_held_out_rows(larger):
    scored = quality_cnn.quality(*larger)
    right, auc = accuracy(scored, larger[1], "quality")
    assert scored.count() == 1000 and right > 0.93 and auc > 0.95


def test_toxicity_on_held_out_rows(larger):
    scored = toxicity.toxicity(*larger)
    right, auc = accuracy(scored, larger[1], "toxic")
    assert scored.count() == 1000 and right > 0.93 and auc > 0.75


def plain_probability(data, model):
    """The score by definition: every window by itself, the largest of each 64 positions, of each four blocks from every third on, then the head."""
    data = data + bytes(max(0, 8 - len(data)))
    data += bytes((len(data) - 8) % 2)
    at = [sum(model.embedding[data[p + k]] @ model.filters[k] for k in range(8)) for p in range(0, len(data) - 7, 2)]
    blocks = [np.max(at[i : i + 64], axis=0) for i in range(0, len(at), 64)]
    chunks, start = [], 0
    while start == 0 or start + 1 < len(blocks):
        chunks.append(np.maximum(np.max(blocks[start : start + 4], axis=0) + model.bias, 0))
        start += 3
    z = np.concatenate((np.max(chunks, axis=0), np.mean(chunks, axis=0), [1.0])) @ model.head
    return 1 / (1 + math.exp(-z))


def test_convolution_against_plain_version():
    rng = np.random.default_rng(5)
    model = quality_cnn.QualityModel(rng.normal(size=(256, 3)), rng.normal(size=(8, 3, 5)), rng.normal(size=5), rng.normal(size=11) / 20)
    tables = model.tables()
    for n in (0, 1, 7, 8, 9, 63, 134, 135, 520, 521, 900, 1291, 3000):
        data = rng.integers(0, 256, n).astype(np.uint8)
        assert quality_cnn.probability(data, model, tables) == pytest.approx(plain_probability(data.tobytes(), model), abs=1e-5)
    long = rng.integers(0, 256, 20_000).astype(np.uint8)
    assert np.array_equal(quality_cnn.pooled(long, tables, model.bias, piece=640), quality_cnn.pooled(long, tables, model.bias))


def test_held_out_labels_are_never_read(spark, larger):
    docs_, labels = larger
    for module, label, args in ((quality_cnn, "quality", (3, 1)), (toxicity, "toxic", (5, 0))):
        held = quality_cnn.fold_is(F.col("doc_id"), *args)
        flipped = labels.withColumn(label, F.when(held, 1 - F.col(label)).otherwise(F.col(label)))
        run = getattr(module, {"quality": "quality", "toxic": "toxicity"}[label])
        few = docs_.where("doc_id < 150")
        assert run(few, labels).select("doc_id", "score").toPandas().equals(run(few, flipped).select("doc_id", "score").toPandas())


def test_maximal_segments_against_definition():
    def plain(s):
        best = max(((sum(s[a:b]), -(b - a), a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        a, b = best[2:]
        return plain(s[:a]) + [(a, b, round(best[0], 6))] + [(x + b, y + b, v) for x, y, v in plain(s[b:])]

    rng = random.Random(4)
    for _ in range(500):
        s = [rng.choice([-3.7, -2.1, -1.3, -0.4, 1.17, 2.31, 0.63]) for _ in range(rng.randint(0, 14))]
        assert [(a, b, round(v, 6)) for a, b, v in toxicity.maximal_segments(np.array(s))] == plain(s)


def test_log_odds_against_plain_version(spark):
    """The scores of tokens (words, and their first 5 and 7 letters) by their definition, and the law that the calibration follows."""
    rng = random.Random(8)
    usual, rude = ([f"{a}{rng.choice('aeiou')}{b}" for a in stems for b in ("", "rd", "rdling")] for stems in (("barn", "fold", "mist", "tr", "quill"), ("grok", "snarlp", "bl")))
    data = []
    for i in range(400):
        bad = i % 4 == 0
        data.append((i, " ".join(rng.choice(rude if bad and rng.random() < 0.3 else usual) for _ in range(rng.randint(5, 30))) + ".", int(bad)))
    sample = spark.createDataFrame(data, "doc_id long, text string, label int")
    fold = {r.doc_id for r in sample.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(10)) < 7).select("doc_id").collect()}
    seen, sizes = Counter(), Counter()
    for i, text, label in data:
        if i in fold:
            sizes[label] += 1
            ws = {w.strip(".") for w in text.split()}
            seen.update({(label, k, w[:n]) for w in ws for k, n in enumerate((None, 5, 7))})
    want = []
    for key in {k[1:] for k in seen}:
        b, g = seen[1, *key], seen[0, *key]
        a = (b + g) * sizes[1] / (sizes[0] + sizes[1])
        if min(sizes.values()) + sizes[1] > max(b, g) + a:
            odds = math.log((b + a) / (2 * sizes[1] - b - a)) - math.log((g + a) / (sizes[0] + sizes[1] - g - a))
            sd = math.sqrt(1 / (b + a) + 1 / (g + a))
            if abs(odds) > 2.58 * sd:
                want.append(min(max(odds - math.copysign(2.58 * sd, odds), -0.5), 6.0))
    model = toxicity.fit_toxicity(sample)
    assert len(want) > 5 and sorted(model.odds) == pytest.approx(sorted(want), abs=1e-9)
    for value, n in ((0.0, 1), (3.0, 20), (8.0, 300)):
        z = (model.scale * value - math.log(n) - model.place) / model.spread
        assert model.surprise(value, n) == pytest.approx(-math.log(1 - math.exp(-math.exp(-z))) if z < 20 else z, rel=1e-6)


def test_classifiers_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(3, 1, 1), (7, 1, 1), (None, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        assert quality_cnn.quality(odd(spark), labels).count() == toxicity.toxicity(odd(spark), labels).count() == len(ODD)
    assert {r.predicted for r in toxicity.toxicity(odd(spark), none).collect()} == {0}


# Odd input for all


def test_every_operator_takes_odd_rows(spark):
    d = odd(spark)
    assert mixing.mix_plan(d).count() == len(ODD) and mixing.mix_sources(d).columns == [*d.columns, "virtual_finish"]
    assert [r.taken for r in mixing.mix_plan(d).where("text is null").collect()] == [0]
    prints = fingerprint.fingerprint_edits(d).collect()
    assert len(prints) == len(ODD) and {r.fingerprint for r in prints if r.n_chars == 0} == {"3::"}
    assert fingerprint.add_fingerprints(d).where("fingerprint is null").count() == 0
    near = minhash.near_duplicates(d).collect()
    assert len(near) == len(ODD) and {(r.component_id, r.kept) for r in near if r.doc_id is None} == {(None, True)}
    assert all(r.component_id == r.doc_id and r.kept for r in near if r.n_shingles == 0)
    assert minhash.drop_near_duplicates(d).columns == d.columns
    assert sorted(str(r.doc_id) for r in sentencepiece.encode(d).where("round_trip").collect()) == sorted(str(r[0]) for r in ODD)
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(d).collect()}[2] == 0
    rules = quality_rules.apply_rules(d).collect()
    assert len(rules) == len(ODD) and all(r.base_failed and not r.kept for r in rules if r.n_words == 0)
    cleaned = {(r.doc_id, r.text) for r in substrings.dedup_substrings(d).collect()}
    assert {(r[0], r[1]) for r in ODD if r[0] != 5} <= cleaned
    assert sum(len(t or "") for i, t in cleaned if i == 5) < len(LONG) / 10  # the first run of a repeating text stays


def test_every_operator_takes_empty_tables(spark):
    d = empty(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    made = [mixing.mix_plan(d), mixing.mix_sources(d), fingerprint.fingerprint_edits(d), minhash.near_duplicates(d), sentencepiece.encode(d), token_counts.count_tokens(d), quality_rules.apply_rules(d), substrings.dedup_substrings(d), quality_cnn.quality(d, labels), toxicity.toxicity(d, labels), toxicity.drop_toxic(d, labels)]
    assert [m.count() for m in made] == [0] * len(made)
