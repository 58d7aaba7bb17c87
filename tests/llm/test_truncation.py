import random

from heliograph.llm import truncation as tr

THINGS = ["lamp", "kettle", "backpack", "toaster", "keyboard", "blender"]
SENTENCES = [
    "I bought the {t} for my {p} and it works every day",
    "the {t} came in a box with {n} other things",
    "after {n} days the colour of the {t} faded badly",
    "my {p} borrowed the {t} and never gave it back",
    "support answered within {n} hours and sent another {t}",
]
SECOND = "Every xylophone quietly rusts beneath my umbrella stand"
PEOPLE = ["brother", "neighbour", "teacher"]
SCHEMA = "doc_id long, text string, source string, title string, chars int"


def sentence(rng):
    return rng.choice(SENTENCES).format(t=rng.choice(THINGS), p=rng.choice(PEOPLE), n=rng.randrange(2, 99))


def corpus():
    rng = random.Random(8)
    docs, cut = [], set()
    for i in range(900):
        parts = [sentence(rng).capitalize() for _ in range(rng.randrange(2, 6))]
        text, source = ". ".join(parts) + ".", rng.choice(["a", "b", " B ", None])
        kind = rng.random()
        if kind < 0.05:
            text = text.rstrip(".")
        elif kind < 0.1:
            text = " ".join(sentence(rng) for _ in range(3))
        elif kind < 0.15:
            text += rng.choice([" 👍", " :)", "!!!", "..", "..."])
        elif kind < 0.25:
            last = parts[-1]
            at = rng.randrange(len(last) // 3, len(last) - 6)
            while last[at - 1] == " ":
                at += 1
            text = ". ".join(parts[:-1]) + ". " + last[:at] + rng.choice(["", "", "…"])
            cut.add(i)
        docs.append((i, text, source, None, 1))
    return docs, cut


def test_finds_cut_texts(spark):
    docs, cut = corpus()
    found = {r.doc_id: r for r in tr.truncated_texts(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert len(cut - found.keys()) <= 0.06 * len(cut)
    assert len(found.keys() - cut) <= 0.03 * len(cut)


def test_limits_copies_and_no_cases(spark):
    docs, _ = corpus()
    docs = [d for d in docs if d[1].endswith(".")]
    rng = random.Random(3)
    whole = "A rather peculiar zygomorphic contraption arrived on monday. Its quaint handle wobbles whenever trains pass by the window."
    extra = [
        (5001, whole, "c", None, 1), (5002, whole[:95], "c", None, 1), (5003, "Great", "c", None, 1), (5004, None, "c", None, 1), (5005, "", "c", None, 1),
        (5006, "   ", "c", None, 1), (5007, docs[0][1] + "\n-- \nHolmi", "c", None, 1), (5008, docs[0][1] + "\nHolmi", "c", None, 1), (5009, "ok", "c", None, 1),
        (5010, "Broke after 48 days", "c", "The lamp came in a box with 3 other things. Nice.", 1), (5011, docs[1][1] + " Caf&#2", "c", None, 1),
        (5012, docs[1][1] + " And it stores R&D", "c", None, 1), (5013, "x" * 100_000, "c", None, 1), (5014, docs[1][1] + " Caf\\u00", "c", None, 1),
        (5015, docs[1][1] + " Then<b", "c", None, 1), (5016, docs[1][1] + " salt &am", "c", None, 1), (5017, docs[1][1] + " caf\ufffd", "c", None, 1),
        (5021, SECOND, "c", None, 1), (5022, SECOND + ".", "c", None, 1), (5023, SECOND + " 👍", "c", None, 1),
        (5018, docs[1][1] + " <3", "c", None, 1), (5019, docs[1][1] + " :\\", "c", None, 1), (5020, docs[1][1] + "<br>", "c", None, 1),
    ]
    limited = []
    for i in range(40):
        text = ". ".join(sentence(rng).capitalize() for _ in range(6))[:150].ljust(150, "q")
        limited.append((6000 + i, text, "d ", None, 1))
    found = {r.doc_id: (r.source, r.evidence) for r in tr.truncated_texts(spark.createDataFrame(docs + extra + limited, SCHEMA)).collect()}
    assert found[5002] == ("c", "copy") and all(found[i][1] == "escape" for i in (5011, 5014, 5015, 5016, 5017))
    assert not found.keys() & {5001, 5003, 5004, 5005, 5006, 5007, 5008, 5009, 5010, 5018, 5019, 5020, 5021, 5022, 5023}
    at_limit = [r for r in limited if tr.Tail(r[1]).open]
    assert sum(found.get(r[0]) is not None for r in at_limit) >= 0.9 * len(at_limit)
    assert all(found[r[0]][0] == "d" for r in at_limit if r[0] in found)


def test_longer_copies(spark):
    base = [f"{'ab' * 10}{i % 7}" for i in range(60)] + ["q" * 30 + c for c in ("", "x", "xy", "z")] + ["short", "shorter"]
    texts = base + base[:10]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(r.doc_id for r in tr.longer_copies(docs, docs).collect())
    want = [i for i, t in enumerate(texts) if len(t) >= tr.COPY_KEY and any(o != t and o.startswith(t) for o in texts)]
    assert got == want


def test_any_longer_copy_decides(spark):
    cut, whole, hot = "Its quaint handle wob", "The colour of the lamp faded", "My neighbour borrowed the toa"
    texts = [cut, cut + "...", cut + ".", cut + "\n", cut + "bles whenever trains pass by.", whole, whole + "!", whole + ".", whole + "\nHolmi"]
    texts += [hot, *(f"{hot}! {i}" for i in range(800)), hot + "ster and never gave it back."]  # over all partitions
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = docs.where(docs.text.isin(cut, whole, hot))
    assert sorted(r.doc_id for r in tr.longer_copies(docs, asked).collect()) == [0, 9]


def test_copies_and_limits_before_few_words_and_names(spark):
    docs, _ = corpus()
    docs = [d for d in docs if d[1].endswith(".")]
    signed = docs[0][1] + "\nIts quaint han"
    extra = ["Peculi", "Peculiar zygomorphic contraption.", "Great", "Greatly improved by now.", "Great, as ever.", signed, signed + "dle wobbles by day.", "A quaint zygom", "A quaint zygomorph arrived.", "Again Kax", "Again Kaxave arrived.", "The Kax works.", "My Kax broke."]
    rows = [(8000 + i, t, "c", None, 1) for i, t in enumerate(extra)]
    rows += [(8100 + i, d[1][:90].ljust(120, "q")[:108] + ".\n" + "Xylopho qu", "f", None, 1) for i, d in enumerate(docs[:5])]
    rows += [(8200 + i, (d[1] * 3)[:100] + " zeb" + "q" * 16, "f", None, 1) for i, d in enumerate(docs[:40])]
    found = {r.doc_id: r.evidence for r in tr.truncated_texts(spark.createDataFrame(docs + rows, SCHEMA)).collect()}
    assert {8000, 8005, 8007} <= found.keys() and not found.keys() & {8001, 8002, 8003, 8004, 8006, 8008, 8009, 8010, 8011, 8012}
    assert [i for i in range(8100, 8105) if found.get(i) != "limit"] == []


def test_limits_of_texts_without_source(spark):
    docs, _ = corpus()
    docs = [d for d in docs if d[1].endswith(".")]
    rows = [(8300 + i, (d[1] * 3)[:130] + " zeb" + "q" * 16, "f" if i > 2 else None, None, 1) for i, d in enumerate(docs[:40])]
    found = {r.doc_id: r.evidence for r in tr.truncated_texts(spark.createDataFrame(docs + rows, SCHEMA)).collect()}
    assert [found.get(i) for i in (8300, 8301, 8302)] == ["limit"] * 3


def test_longer_copies_of_marked_texts(spark):
    whole = ["Its quaint handle %d wobbles whenever trains pass by." % i for i in range(6)]
    ends = ["...", "…", " [...]", "\n", " ... ", " (…)\r\n"]
    texts = whole + [w[:30] + e for w, e in zip(whole, ends)] + ["A rather peculiar lamp" + e for e in ("...", "…", "")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in tr.longer_copies(docs, docs).collect()) == list(range(6, 12))


def test_open_ends():
    cut = "においか\u3099|軽くて静かで、|它很轻，|हमारे कमरे की|the cafe\u0301|A sign (|It works. (|He said \"|彼は「|then he said “|er sagte »|red/|so –|and —|it cost $|about 50 %|don’|一・"
    assert [x for x in cut.split("|") if not tr._unfinished(x)] == []
    whole = "It works.|だ。」|so sad :(|well :-/|hm :\\|he said \"fine\"|« très bien »|(as new)|nice ❤\ufe0f|nice 👍🏽|5\ufe0f\u20e3|でした・・・|うーん、、、|good~|<br>|बहुत अच्छा।|بہت اچھا۔"
    assert [x for x in whole.split("|") if tr._unfinished(x)] == []


def test_finds_cuts_on_marks_and_inner_signs(spark):
    docs, _ = corpus()
    docs = [d for d in docs if d[1].endswith(".")]
    ends = ["軽くて静かで、", "接着剤のにおいか\u3099", "and it works (", "हमारे कमरे की"]
    cut = [(7000 + i, docs[i][1][:40] + "x" * (100 - 40 - len(ends[i % 4])) + ends[i % 4], "e", None, 1) for i in range(24)]
    found = {r.doc_id: r.evidence for r in tr.truncated_texts(spark.createDataFrame(docs + cut, SCHEMA)).collect()}
    assert [c[0] for c in cut if found.get(c[0]) is None] == []


def test_report_and_empty(spark):
    docs, _ = corpus()
    df = spark.createDataFrame(docs, SCHEMA)
    found = tr.truncated_texts(df)
    rows = {r.source: r for r in tr.truncation_report(df, found).collect()}
    assert set(rows) == {"a", "b", None} and sum(r.n_cut for r in rows.values()) == found.count()
    assert rows["a"].rate == rows["a"].n_cut / rows["a"].n_texts
    assert tr.truncated_texts(df.limit(0)).count() == 0
    assert tr.truncation_report(df.limit(0), tr.truncated_texts(df.limit(0))).count() == 0


def test_long_texts_in_pieces_count_alike(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(6)
    texts = [". ".join(sentence(rng) for _ in range(40)) + "." for _ in range(6)] + ["", None, "word", "日本語の文。" * 30]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 4], pa.string())], names=["text"]) for i in (0, 4, 8)]
    everything = np.full(1 << 17, 255, np.uint8)

    def counts():
        total = {}
        for b in tr._count_windows(everything)(iter(batches)):
            for k, more, ended in zip(*(b.column(i).to_pylist() for i in range(3))):
                have = total.get(k, (0, 0))
                total[k] = (have[0] + more, have[1] + ended)
        return total

    monkeypatch.setattr(tr, "LONGEST_RUN", 10**6)
    monkeypatch.setattr(tr, "LONGEST_DENSE_RUN", 10**6)
    whole = counts()
    monkeypatch.setattr(tr, "PIECE", 120)
    monkeypatch.setattr(tr, "LETTERS_AT_ONCE", 10**9)
    assert counts() == whole
    assert len(whole) > 1000


def test_token_arrays_are_the_tokens():
    rng = random.Random(12)
    alphabet = "ab é'’- 0٣½_.!…。日本ก\n\t&<"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(400)] + ["", "it's a well-known 12345 thing", "don’t 1-2'3 --x", "e\u0301te\u0301", "\ud800 x"]
    clean = [tr._clean(t) for t in texts]
    letters = tr.Letters()
    for _ in range(2):
        t = tr.Tokens(letters, clean)
        want = [tr.TOKEN.findall(tr.NUMBER.sub("0", c)) for c in clean]
        assert t.hashes.tolist() == [tr._word_hash(w) for words in want for w in words]
        assert t.text.tolist() == [i for i, words in enumerate(want) for _ in words]
        assert t.place.tolist() == [i for words in want for i in range(len(words))]
        assert t.size.tolist() == [len(w) for words in want for w in words]
        assert t.ends.tolist() == [w in tr.ENDS + "…" for words in want for w in words]
    import numpy as np

    words = [w for x in want for w in x]
    some = np.array([i for i, w in enumerate(words) if len(w) > 3])
    assert t.prefix(some, np.full(len(some), 3)).tolist() == [tr._word_hash(words[i][:3]) for i in some]
