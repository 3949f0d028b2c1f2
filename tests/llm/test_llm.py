"""Each operator against a brute-force version, and on nulls, ties, repeated rows, empty tables and further columns."""

import glob
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import chat, jaccard_join, lattice, mix, pii, suffix_tree, suffixes, toxicity, urls
from gleaner.llm.common import components, shared_folder
from gleaner.llm.decontaminate import contamination

DOC = "doc_id long, text string, source string, node long, id string"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, f"s{i % 3}" if i % 4 else None, -1, "x") for i, t in enumerate(texts)], DOC)


def prose(n, seed=1, words=40):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, words))) for _ in range(n)]
    return [*texts, texts[0], texts[1] + " tail", None, "", " \t ", "Éa " * 300, texts[2] + texts[3] + texts[2]]


def test_components_by_brute_force(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(30)]
    top = {x: x for e in edges for x in e}
    for _ in top:
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: t for x, t in top.items() if x in {y for a, b in edges if a != b for y in (a, b)}}


def test_personal_data(spark):
    text = "é a.b@x.y.z, 1.2.3.4 300.1.1.1, 4111 1111 1111 1111, +1 (555) 123-4567 q@r@s.t"
    got = pii.personal_data(documents(spark, [text, None, ""])).orderBy("doc_id").collect()
    spans = [s.split(":") for s in got[0]["spans"].split(",")]
    assert [(k, text[int(a) : int(b)]) for k, a, b in spans] == [("email", "a.b@x.y.z"), ("email", "r@s.t"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567")]
    assert got[1]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_terms_that_disclose_are_spans_and_are_replaced(spark):
    texts = ["write to zyxname at me@home.org now"] * 2 + ["write to them at the house now"] * 30
    got = pii.personal_data(documents(spark, texts)).where("doc_id = 0").first()
    assert "term:9:16" in got["spans"]
    clean = [r["text"] for r in pii.sanitised(documents(spark, texts)).where("doc_id < 3").orderBy("doc_id").collect()]
    assert clean[0] == "write to  at <email> now" and clean[2] == texts[2]


def test_disclosing_terms_are_replaced_in_whole_documents(spark):
    far = "so it goes on and on " * 8
    texts = [f"zyxname is here {far} me@home.org"] * 2 + [f"mail me@home.org {far} of qquarg"] * 2 + ["only Qquarg, no address"] + [f"{far} is here mail address only of"] * 60
    clean = [r["text"] for r in pii.sanitised(documents(spark, [*texts, None])).orderBy("doc_id").collect()]
    assert clean[0] == f" is here {far} <email>" and clean[2] == f"mail <email> {far} of <term>"
    assert clean[4] == "only <term>, no address" and clean[5:] == [*texts[5:], None]


def test_personal_data_moves_each_text_once(spark):
    docs = documents(spark, ["write to zyxname at me@home.org now"] * 2 + ["write to them at the house now", None] * 9)
    strings = [f.name for f in pii.detect(docs).schema if f.dataType.simpleString() == "string"]
    assert strings == ["text"] and "text" not in pii.detect(docs).schema["own"].dataType.names
    assert [r["text"] for r in pii.sanitised(docs.select("text")).collect()][1:4] == ["write to  at <email> now", "write to them at the house now", None]


def test_texts_without_terms_are_not_moved(spark, monkeypatch):
    rows, few = spark.range(20000).withColumnRenamed("id", "row"), spark.range(0, 20000, 1000).withColumnRenamed("id", "row")
    inside, outside = ([r["row"] for r in part.collect()] for part in pii._parted(rows, few))
    assert sorted(inside + outside) == [*range(20000)] and {*inside} >= {*range(0, 20000, 1000)} and len(inside) < 3000
    assert pii._parted(rows, few.where("row < 0"))[0].isEmpty()
    docs = documents(spark, ["write to zyxname at me@home.org now"] * 2 + ["write to them at the house now", None] * 9 + ["see 1.2.3.4"])
    first = [[str(r[0]) for r in pii.sanitised(docs).select("text").collect()]]
    monkeypatch.setattr(pii, "FILTER_BITS", 6)  # tells nothing apart
    first.append([str(r[0]) for r in pii.sanitised(docs).select("text").collect()])
    assert sorted(first[0]) == sorted(first[1]) == sorted(["write to  at <email> now"] * 2 + ["write to them at the house now", "None"] * 9 + ["see <ip>"])


def test_many_matches_have_right_places(spark):
    text = " ".join(f"u{i}@h.org" for i in range(700))
    got = pii.personal_data(documents(spark, [text])).first()
    assert got["spans"] == ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"\S+", text))


def test_lattice_by_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 16))
    vectors = [*base, *(base[:10] + 0.05 * rng.standard_normal((10, 16))), *base[:3]]
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)] + [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] * 16, 1), (103, [1.0], 1)]
    got = {r["vec_id"]: r for r in lattice.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    unit = np.array([np.float32(v).astype(float) for v in vectors])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    assert [got[i]["n_links"] for i in range(len(unit))] == (near.sum(axis=1) - 1).tolist()
    assert all(got[i]["component_id"] == int(np.flatnonzero(near[i])[0]) for i in range(len(unit)))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in (100, 101, 102, 103))


def test_lattice_decodes_to_the_nearest_point():
    x = np.random.default_rng(1).standard_normal((200, 8)) * 2
    near = lattice.decode(x)
    others = near[:, None, :] + lattice.ROOTS[None]
    assert (((x[:, None] - others / 2) ** 2).sum(-1) >= ((x - near / 2) ** 2).sum(-1)[:, None] - 1e-9).all()


def test_mix_reaches_its_targets(spark):
    docs = documents(spark, prose(400, words=80))
    got = mix.mix(docs, group_rows=32, fan_in=2).toPandas()
    again = mix.mix(docs.repartition(7), group_rows=32, fan_in=2).toPandas()
    key = ["doc_id", "copies"]
    assert sorted(got[key].itertuples(index=False)) == sorted(again[key].itertuples(index=False))
    for _, g in got.groupby("source", dropna=False):
        assert abs((g["size"] * g["copies"]).sum() - g["target"].iloc[0]) <= g["size"].max()
    assert got["copies"].max() <= 3 and got.drop_duplicates("source")["target"].sum() == pytest.approx(got["size"].sum())


def test_jaccard_join_by_brute_force(spark):
    rng, texts = random.Random(7), prose(40, words=60)
    for i in range(60):
        words = (texts[i % 20] or "").split()
        if len(words) > 20:
            words[rng.randrange(len(words))] = f"new{i}"
            texts.append(" ".join(words).upper() if i % 2 else " ".join(words))
    got = {r["doc_id"]: r for r in jaccard_join.groups(documents(spark, texts)).collect()}
    lower = [(t or "").encode().lower().split() for t in texts]
    sets = [{tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set() for w in lower]
    top = list(range(len(texts)))
    links = [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    for _ in top:
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == [(len(s), t) for s, t in zip(sets, top, strict=True)]


def test_colliding_hashes_and_dealt_tokens_change_nothing(spark, monkeypatch):
    texts = [*prose(20, seed=8, words=40), *(f"a passage that all of these share with one another but for the last of its words {i % 9}" for i in range(30))]
    docs = documents(spark, texts).selectExpr("doc_id as id", "doc_id", "text")
    rows = lambda **o: {tuple(r) for r in jaccard_join.similar_documents(docs, percent=70, **o).collect()}
    right = rows()
    monkeypatch.setattr(jaccard_join, "LEAST_HEAVY", 4)
    monkeypatch.setattr(jaccard_join, "TEXTS_A_PART", 2)
    assert rows(bits=7, node_bits=3) == right and len({r[3] for r in right if r[0] >= 27}) == 1


def test_shingles_are_counted_on_words():
    texts = [" ".join(map(str, range(3000))), "a b " * 50, "a", ""]
    for bits in (64, 6):
        assert [len(s) for s in jaccard_join.token_sets(pa.array(texts), 3, bits)] == [2998, 2, 1, 0]


def test_common_grams_of_long_texts_by_brute_force(monkeypatch):
    rng = random.Random(4)
    for n in (1, 3, 5):
        for size in (0, 2, 30):
            a, b = ([rng.choice("abc").encode() for _ in range(size + k)] for k in (0, 3))
            short = jaccard_join.common_grams(a, b, n)
            with monkeypatch.context() as m:
                m.setattr(jaccard_join, "LONG", 0)
                long = jaccard_join.common_grams(a, b, n)
            assert long[2] == short[2] and (long == short or short[2] == 0)


def test_one_of_each_group_stays(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    got = jaccard_join.one_of_each(documents(spark, [text, text, text + " more", "else entirely", None, None]))
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 3, 4, 5] and got.columns == ["doc_id", "text", "source", "node", "id"]


def test_tables_of_words_go_with_the_join(spark):
    before, words = {*glob.glob(f"{shared_folder(spark).removeprefix('file://')}/gleaner-*")}, 0
    kept = jaccard_join.one_of_each(documents(spark, prose(8)))
    for path in {*glob.glob(f"{shared_folder(spark).removeprefix('file://')}/gleaner-*")} - before:
        words += "words" in spark.read.parquet(path).columns
    assert words == 0 and kept.count()


def test_different_texts_with_null_or_repeated_ids_stay(spark):
    texts = [" ".join(f"{c}{i}" for i in range(12)) for c in "abcde"]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (1, texts[2]), (2, texts[2]), (1, texts[3]), (3, texts[4]), (None, texts[4])]
    got = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["text"] for r in got.collect()) == texts


def test_contamination_by_brute_force(spark):
    rng, texts = random.Random(9), prose(30, words=80)
    items = [" ".join((texts[i] or "").split()[5:25]) for i in range(8)] + ["a b", None, "", "..."]
    texts += [f"x {items[rng.randrange(8)]}, y {items[8]}" for _ in range(20)]
    bench = spark.createDataFrame([(i, t, "z") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    got = {r["doc_id"]: r for r in contamination(documents(spark, texts), bench).collect()}
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    for i, t in enumerate(texts):
        w, hit, ids = cut(t), set(), set()
        for k, item in enumerate(map(cut, items)):
            n = min(13, len(item))
            for a in range(len(item) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == item[a : a + n]:
                        hit.update(range(b, b + n))
                        ids.add(str(k))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items_sha256"]) == (len(w), len(hit), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest())


def _tree_by_brute_force(tokens):
    """The log10 probability that a tree of these texts (lists that end with 0) gives a text, and the tree's depth."""
    total, words = sum(map(len, tokens)), Counter(w for t in tokens for w in t)
    root = lambda w: (words[w] + 0.1) / (total + 0.1 * (len(words) + 1))
    states, kept, level, strings = {}, {()}, 0, {(w,) for w in words if words[w] >= 2}

    def p(context, w):
        if not context:
            return root(w)
        if context not in states:
            return p(context[1:], w)
        of, entries = states[context]
        return (entries.get(w, 0) + (of - sum(entries.values()) + 2) * p(context[1:], w)) / (of + 2)

    while kept:
        level += 1
        following = defaultdict(Counter)
        for t in ([0, *t] for t in tokens):
            for i in range(level, len(t)):
                following[tuple(t[i - level : i])][t[i]] += 1
        new, longer = set(), set()
        for c, ws in following.items():
            entries, of = {w: n for w, n in ws.items() if n >= 2}, sum(ws.values())
            if c[1:] not in kept or c not in strings:
                continue
            longer |= {(*c, w) for w in entries}
            gain = sum(n * math.log(n / of / p(c[1:], w)) for w, n in entries.items())
            if gain > len(entries) * 0.5 * math.log(total):
                new.add(c)
                states[c] = (of, entries)
        kept, strings = new, longer

    def score(t):
        return sum(math.log10(p(max((c for c in (tuple([0, *t][j : i + 1]) for j in range(max(0, i + 1 - level), i + 1)) if c in states), key=len, default=()), w)) for i, w in enumerate(t))

    return score, level - 1


def test_suffix_tree_filter_spares_most_strings(spark):
    keys = lambda a, b: spark.range(a, b).selectExpr("xxhash64(id) as k")
    held = suffix_tree.Filter(keys(0, 20000))
    inside, outside = (keys(*x).toPandas()["k"].to_numpy().view(np.uint64) for x in ((0, 20000), (20000, 120000)))
    assert held(inside).all() and held(outside).mean() < 0.04


def test_suffix_tree_leaves_one_table(spark):
    tables = lambda: {*glob.glob(f"{shared_folder(spark).removeprefix('file://')}/gleaner-*")}
    before = tables()
    tree = suffix_tree.train(documents(spark, ["a b c d"] * 9 + ["a b d c"] * 5))
    assert tables() - before == {tree.table.gleaner_path.removeprefix("file://")}


@pytest.mark.parametrize("share", [suffix_tree.SHARE, 1.0])
def test_suffix_tree_by_brute_force(spark, share):
    tail = [f"{a} {b} so it goes on to {c}" for a, b, c in (("one", "day", "home"), ("one", "night", "work"), ("two", "day", "rest"), ("two", "night", "play")) for _ in range(40)]
    deep = ["u u u u z"] * 300  # each further u tells more about when z comes
    texts = [f"the cat sat on the mat and the dog number {i % 5}" for i in range(40)] + prose(10) + tail + deep
    got = {r["doc_id"]: r for r in suffix_tree.scores(documents(spark, texts), share=share).collect()}
    tokens = [[*(t or "").encode().lower().split(), 0] for t in texts]
    train = [t for i, t in enumerate(tokens) if zlib.crc32(str(i).encode()) % 10]
    words = Counter(w for t in train for w in t)
    n, v = sum(words.values()), len(words)
    score, depth = _tree_by_brute_force(train)
    assert depth >= 3
    for i, t in enumerate(tokens):
        assert got[i]["base_score"] == pytest.approx(sum(np.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert got[i]["n_tokens"] == len(t) and got[i]["n_known"] == sum(w in words for w in t) and got[i]["train_tokens"] == n
        assert got[i]["score"] == pytest.approx(score(t))
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_restoration_and_score(spark):
    rng = random.Random(3)
    clean = [t for t in prose(300, words=30)[:300]]
    texts = [f"{t} {rng.choice(['idiot', 'moron', 'loser'])} {t}" if i % 4 == 0 else t for i, t in enumerate(clean)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.train(documents(spark, texts), labels)
    restorer = toxicity.Restorer(model.chars)
    said = ["you 1d10t", "you m0r0n!", "an i d i o t here", "i.d.i.o.t", "looooser", "the abc", "", None]
    scores = model.scores(pa.array(said), restorer)
    assert (scores[:5] >= 0.7).all() and (scores[5:] < 0.7).all()


def obfuscated(rng, word):
    say = {"i": "1", "o": "0", "s": "$", "e": "3", "a": "@"}
    forms = ["".join(say.get(c, c) for c in word), " ".join(word), ".".join(word), "".join(c * (1 + (rng.random() < 0.5)) for c in word) + word[-1] * 2, word[:2] + "*" + word[3:], word.upper()]
    return rng.choice(forms)


def test_held_out_accuracy(spark):
    rng = random.Random(6)
    clean = prose(600, words=30)[:600]
    insults = ["idiot", "moron", "loser", "stupid"]
    texts = [f"{t} {obfuscated(rng, rng.choice(insults)) if i % 8 == 0 else rng.choice(insults)} {t}" if i % 4 == 0 else t for i, t in enumerate(clean)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    got = [r for r in toxicity.toxicity(documents(spark, texts), labels).collect() if r["held_out"]]
    right = [r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got]
    print("held-out accuracy", sum(right) / len(right), "of", len(right))
    assert len(right) > 150 and sum(right) / len(right) >= 0.97


def test_labels_too_many_to_broadcast_give_the_same_scores(spark, monkeypatch):
    texts = [f"{'idiot' if i % 3 == 0 else 'fine'} words {i % 5} here" for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (5, 0)], "doc_id long, toxic int")
    rows = lambda: sorted(toxicity.toxicity(documents(spark, texts), labels).select("doc_id", "score").collect())
    right = rows()
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 0)
    assert rows() == right


def test_what_the_gate_sends_to_the_decoder():
    def found(text):
        data = np.frombuffer(text.encode(), np.uint8)
        s, e, _ = toxicity.suspects(data, np.array([0, len(data)]))
        return [text.encode()[a:b].decode() for a, b in zip(s, e, strict=True)]

    for word in ("a$$", "A$$", "iddiott", "idi*t", "1d10t", "i.d.i.o.t", "looser00", "iiidiot", "i d i o t"):
        assert found(f"an {word} és") == [word], word
    assert found("hello! well, letter a b and-so on. (see) és") == []


def test_character_model_counts_all_labelled_rows(spark):
    texts = [f"{'plain words here' if i % 2 else 'zyxquarg idiot'} w{i}" for i in range(40)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(40)], "doc_id long, toxic int")
    docs = documents(spark, texts)
    few, all_rows = (toxicity.train(docs, labels, sample_rows=n).chars for n in (4, 100))
    assert few.counts == all_rows.counts and few.counts["zyx"] == 20


def test_url_rules_and_model(spark):
    said = {
        "http://a.net/x": "net/", "http://a.example.net/en/1": "example.net/en/", "http://example.com/de/": "example.com/de/", "http://B.ORG/fr/x?q": "org/fr/",
        "http://a.net": None, "http://anet/x": None, "nothing": None, "http://cheap-pills.example.com/en/1": None,
    }
    rows = [*enumerate(said), (99, None)]
    got = {r["page_id"]: r for r in urls.verdicts(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [got[i]["rule"] for i in range(len(said))] == [*said.values()]
    assert got[7]["verdict"] == "block" and got[99]["host"] == got[99]["path"] == "" and got[3]["host"] == "b.org"


def test_urls_of_hosts_that_were_not_learned(spark):
    bad = "bestpokerbonus.com casino-lottery.info cheapviagra.biz www.free-jackpot.org payday-cash.co.uk adultwebcam.com buy-pills.example.com win-lotto-cash.com".split()
    good = "citylibrary.org www.river-museum.com poetryjournal.de villagebakery.co.uk physics-archive.org harbournews.info teachers-forum.com chess-school.org thenenough.com".split()
    pages = ("/", "/en/1", "/en/77", "/de/216.html", "/a/b/c?utm=1", "/2020/01/x#top")
    table = [host for host, _ in urls.labelled_table()]
    assert not any(f"://{h}/" in u for h in bad + good for u in table)
    rows = [(h, f"https://{h}{p}") for h in bad + good for p in pages]
    got = urls.judge(spark.createDataFrame(rows, "host_name string, url string"), rules=()).collect()
    right = sum((r["verdict"] == "block") == (r["host_name"] in bad) for r in got)
    stable = sum(len({r["verdict"] for r in got if r["host_name"] == h}) == 1 for h in bad + good)
    print("right", right / len(got), "of", len(got), "; one verdict for all pages", stable, "of", len(bad + good), "hosts")
    assert right / len(got) >= 0.9 and stable >= len(bad + good) - 1


def test_chat_round_trip(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "<\\|x <\\\\| \\n", "", None, "a<", "|b>\n<|"]
    rows = [(1, i, ["user", "assistant", "a\nb\\n"][i % 3], t, "x") for i, t in enumerate(texts)]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string"))
    got = made.select(chat.read_back(made["formatted"]).alias("turns"), chat.masked_text(made["formatted"], made["loss_mask"]).alias("loss")).first()
    assert [(t["role"], t["text"]) for t in got["turns"]] == [(r, t or "") for _, _, r, t, _ in rows]
    assert got["loss"] == "".join(t or "" for _, _, r, t, _ in rows if r == "assistant")


def test_chat_parts_become_placeholders(spark):
    part = lambda kind, **x: {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | x
    rows = [(1, 0, "user", [part("text", text="see <|"), part("image", ref="a.png", width=28, height=15), part("audio", ref="b.wav", seconds=2.0)]), (1, 1, "assistant", [part("document", ref="c.pdf", pages=2)])]
    made = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>"), parts=chat.F.col("parts")).first()
    assert "see <\\|<|part|><|image:0|><|part|><|audio:1|>" in made["formatted"] and "<|document:2|>" in made["formatted"]
    assert [(a["number"], a["ref"], a["tokens"]) for a in made["attachments"]] == [(0, "a.png", 4), (1, "b.wav", 50), (2, "c.pdf", 512)]


@pytest.mark.parametrize("bucket", [16, 16_384])
def test_repeats_by_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    small = suffixes._by_bucket
    monkeypatch.setattr(suffixes, "_by_bucket", lambda batches: small(batches, bucket))
    rng = random.Random(11)
    line = "a line that very many of the documents share, with more than one hundred bytes in it so that it counts, é."
    texts = prose(25, words=90) + [f"{rng.random()} {line} {rng.random()}" for _ in range(40)] + ["ab" * 400]
    got = {r["doc_id"]: r for r in suffixes.removed(documents(spark, texts)).collect()}
    seen = set()
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(b), sum(gone), hashlib.sha256(kept).hexdigest())
        assert got[i]["n_spans"] == len(re.findall(rb"\x01+", bytes(gone)))


def test_multikey_sort():
    rows = np.random.default_rng(5).integers(0, 3, (500, 21)).astype(np.uint8)
    assert [bytes(r) for r in rows[suffixes.multikey_sort(rows)]] == sorted(bytes(r) for r in rows)


def test_empty_tables(spark):
    none = documents(spark, []) if False else spark.createDataFrame([], DOC)
    labels, bench = spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([], "item_id long, text string")
    made = (pii.personal_data(none), mix.mixture(none), jaccard_join.groups(none), contamination(none, bench), suffix_tree.scores(none), toxicity.toxicity(none, labels), suffixes.removed(none))
    assert all(df.count() == 0 for df in made)
    assert lattice.near_copies(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_repeated_and_null_ids(spark):
    rows = spark.createDataFrame([(1, "same text here again and again " * 8), (1, "same text here again and again " * 8), (None, "other"), (None, None)], "doc_id long, text string")
    assert suffixes.removed(rows).count() == jaccard_join.groups(rows).count() == pii.personal_data(rows).count() == 4
    assert suffix_tree.scores(rows).count() == mix.mixture(rows.selectExpr("*", "'s' as source")).count() == 4


NAMES = "row own of base terms told all_told id node words rest token part n email ip card phone bench_words bench_runs bench_items _toxicity key pos deal unit cell".split()


def test_columns_of_any_name_come_back(spark):
    from gleaner.llm.decontaminate import clean_documents

    texts = ["mail a.b@x.org now " + "word " * 20, "other things are said in here, quite plainly", "mail a.b@x.org now " + "word " * 20]
    docs = spark.createDataFrame([(i, t, *range(100, 100 + len(NAMES))) for i, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in NAMES))
    bench = spark.createDataFrame([(1, "no such text")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 0)], "doc_id long, toxic int")
    made = {"pii": pii.sanitised(docs), "join": jaccard_join.one_of_each(docs), "bench": clean_documents(docs, bench), "toxicity": toxicity.without_toxic(docs, labels)}
    for name, df in made.items():
        assert df.columns == docs.columns, name
        assert all([r[n] for n in NAMES] == [*range(100, 100 + len(NAMES))] for r in df.collect()) and df.count() >= 2, name


@pytest.mark.parametrize("part_words", [1, 50])
def test_many_benchmark_parts_give_what_one_gives(spark, part_words):
    from gleaner.llm.decontaminate import decontaminate

    texts = prose(12, words=60)
    items = [" ".join((texts[i] or "").split()[2:22]) for i in range(6)]
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    rows = lambda **o: sorted((r["doc_id"] is None, r["doc_id"], r["bench_words"], str(r["bench_runs"]), str(r["bench_items"]), r["node"]) for r in decontaminate(documents(spark, texts), bench, **o).collect())
    assert rows(part_words=part_words) == rows()


def test_texts_of_many_megabytes(spark):
    from gleaner.llm.decontaminate import contamination

    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(700))
    long = " ".join(f"w{rng.randrange(10**6)}" for i in range(1_200_000))  # more than 8 MB
    assert len(long) > 1 << 23
    docs = documents(spark, [passage, f"{long} {passage}"])
    bench = spark.createDataFrame([(1, passage[:200])], "item_id long, text string")
    assert suffixes.removed(docs).where("doc_id = 1").first()["n_removed"] >= len(passage)
    assert contamination(docs, bench).where("doc_id = 1").first()["n_items"] == 1


def test_shared_folder_must_be_named_on_a_cluster(spark):
    from types import SimpleNamespace

    from gleaner.llm import common

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_folder(far)
