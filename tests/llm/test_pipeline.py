"""The pipeline's stages against brute-force versions, each on what the one before it kept, and the whole run."""

import random
import re

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary(rng, letters):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(80)]


@pytest.fixture
def tables(spark, tmp_path):
    """(folder, texts by doc_id, ids of toxic documents, items): planted copies, passages, personal data and insults."""
    rng = random.Random(5)
    words, others = vocabulary(rng, "abcdefgh"), vocabulary(rng, "mnopqrs")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(8, 70))) for _ in range(240)]
    toxic = set(range(0, 240, 4))
    for i in toxic:
        texts[i] = f"{texts[i]} {('idiot', 'moron')[i // 4 % 2]} {texts[i + 1]}"
    items = [" ".join(rng.choice(others) for _ in range(20)) for _ in range(5)]
    long = max((i for i in range(240) if i not in toxic), key=lambda i: len(texts[i]))
    texts += [texts[long], texts[long] + " tail", f"{texts[1]} {items[2]}", f"{texts[2]} {items[3].upper()} end", "mail someone at a.b@x.org today", "", None, None]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([*enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), dict(enumerate(texts)), toxic, items


def one_of_each(texts):
    sets = {i: (lambda w: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())((t or "").lower().split()) for i, t in texts.items()}
    top = {i: i for i in texts}
    links = [(a, b) for a in texts for b in texts if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in links:
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    return {i for i in texts if top[i] == i}


def contaminated(text, items):
    words, hit = re.findall(r"[a-z0-9]+", (text or "").lower()), set()
    for item in (i.split() for i in items):
        for a in range(len(item) - 12):
            hit |= {p for b in range(len(words) - 12) if words[b : b + 13] == item[a : a + 13] for p in range(b, b + 13)}
    return bool(hit) and 20 * len(hit) >= len(words)


def shares(sizes):
    """The sources' targets from {source: size}: weights 1, 2, 3, repeating; no more than three times the size."""
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    full: set = set()
    while True:
        rest = sum(sizes.values()) - 3 * sum(sizes[s] for s in full)
        goal = {s: 3 * sizes[s] if s in full else rest * weight[s] / sum(w for x, w in weight.items() if x not in full) for s in sizes}
        more = {s for s in sizes if goal[s] > 3 * sizes[s]}
        if not more:
            return goal
        full |= more


def test_stages_by_brute_force(spark, tables):
    import corpus_pipeline
    from gleaner.llm.common import cut, read

    folder, texts, toxic, items = tables
    stage = dict(corpus_pipeline.STAGES)
    docs = read(spark, folder, "documents")
    kept = dict(texts)

    def after(name):
        nonlocal docs
        columns = docs.columns
        docs = cut(stage[name](spark, docs, folder))
        assert docs.columns == columns
        return {r["doc_id"]: r["text"] for r in docs.collect()}

    kept = {i: t for i, t in kept.items() if i not in toxic}
    assert after("toxicity") == kept
    firsts = one_of_each(kept)
    kept = {i: t for i, t in kept.items() if i in firsts}
    assert 240 not in kept and 241 not in kept and after("near_copies") == kept
    kept = {i: t for i, t in kept.items() if not contaminated(t, items)}
    assert 242 not in kept and 243 not in kept and after("decontamination") == kept
    got = after("personal_data")
    kept[244] = kept[244].replace("a.b@x.org", "<email>")
    assert {i: t or "" for i, t in got.items()} == {i: t or "" for i, t in kept.items()}
    rows = stage["mixture"](spark, docs, folder).toPandas()
    assert dict(zip(rows["doc_id"], rows["size"], strict=True)) == {i: len((t or "").split()) for i, t in kept.items()}
    sizes = {None if s != s else s: int(n) for s, n in rows.groupby("source", dropna=False)["size"].sum().items()}
    goal = shares(sizes)
    for s, g in rows.groupby("source", dropna=False):
        assert g["target"].iloc[0] == pytest.approx(goal[None if s != s else s])
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max()
    assert (rows["taken"] <= 3 * rows["size"]).all()
    again = corpus_pipeline.run(spark, folder).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(again[key].itertuples(index=False)) == sorted(rows[key].itertuples(index=False))
