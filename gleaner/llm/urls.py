"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained on the driver from a small labelled table (``labelled_table()`` unless another is given) and has
``2 ** bits`` weights, whatever the data. N-grams of 3 to 5 bytes, of the host between marks and of the path, are
hashed together with the part that they are from.

Defined cases: a null url, or one without ``://``, has empty host and path; the model judges those as well (as allowed,
unless trained otherwise); repeated rows give repeated verdicts; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import ascii_lower

#: (verdict, host, path); the path begins with the slash. Fixed by the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BITS, GRAMS, STEPS, RATE, RIDGE, BLOCK_AT = 18, (3, 4, 5), 300, 0.5, 1e-3, 0.5

#: The labelled table is made of these by rule: words that unwanted hosts are made of, and words of wanted ones. They are
#: general words of either kind; no host of any table is among them.
UNWANTED = (
    "casino poker slots roulette jackpot betting bookie wager gamble lotto lottery sweepstakes pills pharmacy viagra cialis meds steroids slimming dietpills loans payday "
    "lender creditfix porn xxx adult sexcam webcam escort hookup fetish nude erotic replica knockoff fake cheap discount bargain deals coupon clearance free bonus prize "
    "winner giveaway cash money earn profit income getrich millionaire forex binary pump bitcoin miner warez crack keygen serials torrent nulled hack cheats spam bulkmail "
    "seo backlink linkfarm traffic clicks popup popads adserver tracker banner toolbar malware phish scam"
).split()
WANTED = (
    "news times herald gazette journal library museum gallery theatre opera orchestra archive university college school academy institute faculty science physics "
    "chemistry biology astronomy geology botany mathematics history philosophy poetry novel painting sculpture weather climate river harbour island mountain valley forest "
    "garden farm kitchen recipes bakery cafe market village town city council parliament court police hospital clinic nurse railway airport bridge castle church abbey "
    "cycling hiking sailing football tennis chess travel hotel camping radio studio software code kernel docs wiki forum blog notes teacher student workshop"
).split()
#: Frequent letter groups of English, German, French and Spanish: names made of these say nothing, and count as wanted.
GROUPS = (
    "tion ment ing the and that ble ness ough ight er est or an he re ou th sh wh st un ver ein ich sch ung heit keit lich gen auf les que eau oir ette ance eur ais "
    "ciones dad mente ando iento os as la el ado"
).split()
PAGES = ("/", "/en/17", "/fr/905/", "/index.html", "/2024/05/a-day-out", "/p/77120.html", "/de/list?page=2", "/articles/how-it-began", "/es/4", "/about/")


def host_names(words: list[str]) -> list[str]:
    """Hosts of one word and of two, joined in several ways, under several names and domains."""
    n, out = len(words), []
    for i, word in enumerate(words):
        other, third = words[(7 * i + 3) % n], words[(11 * i + 5) % n]
        out += [f"{('', 'www.')[i % 2]}{word}{('.com', '.net', '.org', '.info')[i % 4]}", f"{('www.', '', 'm.')[i % 3]}{word}-{other}.{('example.', '')[i % 2]}{('org', 'com', 'net')[i % 3]}"]
        out += [f"{('blog.', '', 'shop.')[i % 3]}{third}{word}.{('co.uk', 'example.com', 'de')[i % 3]}", f"{word}{i % 90 + 10}.{('example.net', 'org', 'biz')[i % 3]}"]
    return out


def labelled_table() -> list[tuple[str, int]]:
    """(url, 1 for unwanted). Hosts of both kinds have the same pages, so that these say nothing."""
    n = len(GROUPS)
    names = [GROUPS[i % n] + GROUPS[(i * (2 + i // n) + 1) % n] + (GROUPS[(5 * i + 2) % n] if i % 3 == 0 else "") for i in range(8 * n)]
    hosts = [(h, label) for label, words in ((1, UNWANTED), (0, WANTED), (0, names)) for h in host_names(words)]
    return [(f"https://{host}{PAGES[(i + 3 * k) % len(PAGES)]}", label) for i, (host, label) in enumerate(hosts) for k in range(3)]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. Of rules of equal length the first wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, of, begin in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(begin)
        rule, verdict = F.when(fits, F.lit(of + begin)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def features(hosts: pa.Array, paths: pa.Array, bits: int = BITS) -> Iterator[np.ndarray]:
    """For each pair the distinct hashed n-grams, as places in the weights."""
    both = pa.array([f"\x01{h or ''}\x02{p or ''}\x03" for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)], pa.large_string())
    for _, data, offsets in tb.slices(both):
        sums = tb.prefix_hash(data)
        for i in range(len(offsets) - 1):
            a, b = int(offsets[i]), int(offsets[i + 1])
            mid = a + int(np.argmax(data[a:b] == 2)) + 1  # the path's first byte
            grams = []
            for part, (s, e) in enumerate(((a, mid), (mid, b))):
                for n in GRAMS:
                    at = np.arange(s, max(s, e - n + 1))
                    grams.append(tb.mixed(tb.span_hash(sums, at, at + n) + np.uint64(part)))
            yield np.unique(np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int64)


def train(table: list[tuple[str, int]], bits: int = BITS) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent with an L2 penalty; the same table gives the same model."""
    hosts, paths = zip(*[_split(u) for u, _ in table], strict=True)
    rows = [*features(pa.array(hosts, pa.string()), pa.array(paths, pa.string()), bits)]
    y = np.array([label for _, label in table], dtype=float)
    used, at = np.unique(np.concatenate(rows), return_inverse=True)  # n-grams that stand nowhere keep the weight zero
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value = 1 / np.sqrt(np.maximum([len(r) for r in rows], 1))
    w, bias = np.zeros(len(used)), 0.0
    for _ in range(STEPS):
        z = np.bincount(owner, w[at], len(rows)) * value + bias
        gap = 1 / (1 + np.exp(-z)) - y
        w -= RATE * (np.bincount(at, (gap * value)[owner], len(used)) + RIDGE * w)
        bias -= RATE * gap.mean()
    whole = np.zeros(1 << bits)
    whole[used] = w
    return whole, bias


def _split(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    path = rest[end:].partition("?")[0].partition("#")[0]
    return rest[:end].lower(), path


def judge(pages: DataFrame, *, url: str = "url", rules=RULES, labelled: list[tuple[str, int]] | None = None, bits: int = BITS) -> DataFrame:
    """``pages`` with host, path, rule, verdict and block_score (the model's probability), replacing such columns."""
    model = pages.sparkSession.sparkContext.broadcast(train(labelled or labelled_table(), bits))
    host, path = host_and_path(F.col(f"`{url}`"))
    made = ("host", "path", "rule", "verdict", "block_score")
    own = [F.col(f"`{c}`") for c in pages.columns if c not in made or c == url]
    parsed = pages.select(*own, F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path")).withColumn("block_score", F.lit(0.0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = model.value
        for batch in (part for whole in batches for part in tb.bounded(whole, "host", "path")):
            z = [bias + w[f].sum() / max(len(f), 1) ** 0.5 for f in features(batch.column("host"), batch.column("path"), bits)]
            scores = pa.array(1 / (1 + np.exp(-np.array(z, dtype=float))), pa.float64())
            columns = [scores if n == "block_score" else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    scored = parsed.mapInArrow(score, parsed.schema)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("block_score") >= BLOCK_AT, F.lit("block")).otherwise(F.lit("allow"))
    return scored.withColumns({"rule": rule, "verdict": F.coalesce(verdict, by_model)})


def verdicts(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, block_score."""
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_score")
