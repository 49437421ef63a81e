"""URL filters: a logistic regression on hashed character n-grams of host and path, below rules.

The model is trained on the driver from a small labelled URL table (at most MAX_LABELS rows)
and is a vector of fixed size, sent with the scoring function.  Scoring is one pass over the
URLs without a shuffle; rules are plain column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: n-gram lengths, size of the hashed feature space, and the most labelled rows that training reads.
GRAMS, SIZE, MAX_LABELS = (3, 4, 5), 1 << 16, 20_000
#: At most about one in a hundred URLs of ordinary words and path shapes that training did not see is then blocked.
THRESHOLD = 0.55


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The production rules.
RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))

#: Subjects of public block lists of URLs: gambling, drugs by post, adult, advertising and tracking, piracy, fraud, link farms.
UNWANTED = {
    "gambling": "casino poker slots jackpot betting roulette bingo lottery blackjack wager sportsbook baccarat gamble bookmaker",
    "drugs": "viagra cialis pharmacy pills tablets steroids tramadol xanax weightloss potency",
    "adult": "porn xxx sex nude escort erotic webcam hentai milf fetish adult hookup",
    "ads": "adserver tracker popunder banner adclick affiliate telemetry pixel retarget doubleclick impression ads",
    "piracy": "warez torrent keygen crack serials nulled cracked pirate leaked modapk",
    "fraud": "payday loans prize giveaway winner phishing malware bitcoin-doubler fastcash getrich replica fake",
    "farms": "spam linkfarm backlinks doorway autoblog contentfarm clickbait seoboost botnet trafficbot",
}
#: Subjects of ordinary sites.
WANTED = {
    "learning": "school college university library science history physics biology chemistry mathematics language dictionary lessons museum academy archive",
    "news": "news times herald gazette journal magazine radio weather tribune courier chronicle report",
    "home": "garden kitchen recipes bakery furniture cleaning family parents wedding knitting pottery flowers",
    "health": "health doctor clinic dental hospital nursing fitness yoga nutrition therapy",
    "places": "travel city village mountain river forest island harbour hotel railway airport bridge council parish",
    "arts": "music cinema theatre gallery books poetry painting orchestra photo dance festival opera",
    "work": "office legal accounting builders plumbing engineering software hardware farming logistics energy printing bank insurance",
    "people": "community forum wiki blog charity church football tennis cycling chess scouts hiking fishing sailing",
}
#: What stands around a subject in a host name, whether the site is wanted or not.
AROUND = ("{0}", "my{0}", "the-{0}", "{0}online", "{0}-world", "go{0}", "super{0}", "{0}24", "{0}-hub", "{0}zone", "best-{0}", "daily{0}")
PREFIXES = ("", "www.", "m.", "blog.", "static.", "shop.")
DOMAINS = ("com", "org", "net", "info", "io", "co.uk", "de", "fr", "es", "biz")
#: Paths that either class has, and those of unwanted sites (tracking, redirects, offers, sessions, parked pages, cracked downloads) and of ordinary ones.
PATHS = ("", "/", "/index.html", "/en/{1}", "/{0}/{1}.html", "/{1}/")
UNWANTED_PATHS = (
    "/click/{1}/out", "/redirect/{1}/landing", "/track/{1}/pixel.gif", "/aff/{1}/offer",
    "/go/{1}/signup-bonus", "/promo/free-{0}-bonus", "/out/click/{1}", "/adserve/{1}/banner.gif",
    "/offer/{1}/claim-now", "/sess/{2}/click", "/win/claim-prize/{1}", "/free-download/{0}-full-crack",
    "/banner/track/{1}.gif", "/buy-cheap-{0}-online/{1}", "/parked/{2}/landing", "/cheap-{0}-no-prescription",
    "/download/{0}-crack-keygen/{1}", "/aff/redirect/{2}", "/sponsored/{1}/offer", "/free-trial-{0}/join-now",
    "/bonus/{1}/win-prize", "/pixel/sess/{2}.gif", "/promo/{1}/buy-now", "/xxx-{0}-videos/free/{1}",
)
WANTED_PATHS = (
    "/articles/{1}/{0}-guide.html", "/docs/{0}/chapter-{3}.html", "/news/2019/{3}/{0}", "/events/{0}/programme",
    "/library/{0}/catalogue", "/about-us/team", "/guide/{0}/introduction", "/members/{1}/profile",
    "/research/papers/{1}.pdf", "/history/{0}.html", "/contact/opening-hours", "/wiki/{0}",
    "/gallery/{0}/{1}.jpg", "/timetable/{3}/programme", "/support/faq/{0}", "/news/archive/{1}",
    "/team/{0}/profile", "/articles/history-of-{0}", "/wiki/{0}/discussion", "/docs/faq/{1}.html",
    "/opening-hours", "/events/archive/2018/{3}", "/library/papers/{1}", "/support/contact/{0}",
)
#: Share of unwanted URLs that training assumes.
PRIOR = 0.2


def seed_words() -> list[tuple[str, int]]:
    """(word, unwanted) of the seed subjects."""
    return [(word, label) for label, lists in ((1, UNWANTED), (0, WANTED)) for words in lists.values() for word in words.split()]


def seed_labels(words: Sequence[tuple[str, int]] | None = None, shapes: Sequence[int] | None = None, plain: bool = True) -> pd.DataFrame:
    """The small labelled table (url, unwanted) made by rule from subject words and path shapes.

    Each word takes every surrounding of AROUND twice, with prefixes and domains in turn that
    do not depend on the label, and with paths of which one in four (`plain`) is one that either
    class has; the others are those of its class (with `shapes` only these numbers of them).
    """
    rows = []
    shapes = range(len(UNWANTED_PATHS)) if shapes is None else shapes
    for i, (word, label) in enumerate(seed_words() if words is None else words):
        for j in range(2 * len(AROUND)):
            host = PREFIXES[(i + j) % len(PREFIXES)] + AROUND[j % len(AROUND)].format(word) + "." + DOMAINS[(i * 3 + j) % len(DOMAINS)]
            number = i * 7 + j * 31
            own = PATHS[(i * 5 + j // 4) % len(PATHS)] if plain and j % 4 == 3 else (UNWANTED_PATHS if label else WANTED_PATHS)[shapes[(i * 11 + j) % len(shapes)]]
            rows.append((f"https://{host}{own.format(word, number, xxhash.xxh32_hexdigest(word, number), number % 12 + 1)}", label))
    return pd.DataFrame(rows, columns=["url", "unwanted"])


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or no `://`."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end; empty for null or no `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null; the first of equally long ones."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: -len(r.text))[::-1]:
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def features(hosts: Sequence[str], paths: Sequence[str], size: int = SIZE, grams: Sequence[int] = GRAMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of hashed n-grams; host and path have marked ends and do not share columns."""
    rows, columns = [], []
    for part, texts in ((1, hosts), (2, paths)):
        raw = [b"^" + t.encode() + b"$" for t in texts]
        bytes_ = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        row = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        for n in grams:
            if len(bytes_) < n:
                continue
            key = np.full(len(bytes_) - n + 1, part * 31 + n, np.uint64)
            for k in range(n):
                key = (key * np.uint64(0x100000001B3)) ^ bytes_[k : len(bytes_) - n + 1 + k]
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            whole = row[: len(key)] == row[n - 1 :]
            rows.append(row[: len(key)][whole])
            columns.append((key[whole] >> np.uint64(40)).astype(np.int64) % size)
    row = np.concatenate(rows) if rows else np.empty(0, np.int64)
    column = np.concatenate(columns) if columns else np.empty(0, np.int64)
    cell, count = np.unique(row * size + column, return_counts=True)
    row, value = cell // size, np.log1p(count)
    norm = np.sqrt(np.bincount(row, value * value, minlength=len(hosts)))
    return row, cell % size, value / norm[row]


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path as host_of and path_of give them, for training rows."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:end].translate({c: c + 32 for c in range(65, 91)}), tail[:stop]


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def score(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        row, column, value = features(hosts, paths, len(self.weights))
        z = np.bincount(row, value * self.weights[column], minlength=len(hosts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def loss_and_slope(weights: np.ndarray, bias: float, cells: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, share: np.ndarray, penalty: float) -> tuple[float, np.ndarray, float]:
    """Weighted logistic loss with a penalty of penalty / 2 times the squared weights, and its slope by weights and bias."""
    row, column, value = cells
    z = np.bincount(row, value * weights[column], minlength=len(y)) + bias
    loss = float(share @ (np.logaddexp(0, z) - y * z) + penalty / 2 * weights @ weights)
    off = share * (1 / (1 + np.exp(-z)) - y)
    return loss, np.bincount(column, value * off[row], minlength=len(weights)) + penalty * weights, float(off.sum())


def train(labels: pd.DataFrame, rounds: int = 400, rate: float = 40.0, penalty: float = 1e-5) -> UrlModel:
    """Full-batch gradient descent, classes weighted by the prior; labels: url and unwanted (0 or 1); empty: all wanted.

    Of more than MAX_LABELS rows those with the lowest hashes of the url are read, whatever
    the table's order.
    """
    if len(labels) > MAX_LABELS:
        order = np.argsort([xxhash.xxh64_intdigest(str(u)) for u in labels["url"]], kind="stable")
        labels = labels.iloc[order[:MAX_LABELS]]
    y = labels["unwanted"].to_numpy(float)
    model = UrlModel(np.zeros(SIZE), 0.0 if len(y) else -1.0)
    if not len(y):
        return model
    share = np.where(y > 0, PRIOR / max(y.sum(), 1), (1 - PRIOR) / max((1 - y).sum(), 1))
    hosts, paths = zip(*map(split_url, labels["url"]), strict=True)
    cells = features(hosts, paths)
    for _ in range(rounds):
        _, by_weight, by_bias = loss_and_slope(model.weights, model.bias, cells, y, share, penalty)
        model.weights -= rate * by_weight
        model.bias -= rate / 10 * by_bias
    return model


def with_verdict(pages: DataFrame, url: str = "url", into: str = "url_filter", rules: Sequence[Rule] = RULES, labels: pd.DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """`pages` with a struct column `into`: host, path, rule, verdict (block or allow), score.

    A null url, or one without `://`, has empty host and path; no rule fits it and the model
    scores the empty strings.  Rows may repeat; other columns stay as they are, and `into` is
    lengthened by `_` where `pages` has a column of that name in any case.
    """
    model = train(seed_labels() if labels is None else labels)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            yield pd.Series(model.score(hosts.tolist(), paths.tolist()))

    raw, into = free_name(pages, "url_parts"), free_name(pages, into)
    u = F.col(f"`{url}`")
    parts = pages.withColumn(raw, F.struct(host_of(u).alias("host"), path_of(u).alias("path")))
    host, path = F.col(raw)["host"], F.col(raw)["path"]
    rule, points = free_name(parts, "url_rule"), free_name(parts, "url_score")
    judged = parts.withColumn(points, score(host, path)).withColumn(rule, rule_for(host, path, rules))
    own = F.when(F.col(points) >= threshold, "block").otherwise("allow")
    whole = F.struct(host.alias("host"), path.alias("path"), F.col(rule)["rule"].alias("rule"), F.coalesce(F.col(rule)["verdict"], own).alias("verdict"), F.col(points).alias("score"))
    return judged.withColumn(into, whole).drop(raw, rule, points)
