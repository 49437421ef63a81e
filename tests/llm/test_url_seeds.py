"""The URL model on words that training does not see."""

from __future__ import annotations

import numpy as np
import pandas as pd

from hydroloom.llm import url_filter


def blocked(model, urls):
    hosts, paths = zip(*map(url_filter.split_url, urls), strict=True)
    return model.score(hosts, paths) >= url_filter.THRESHOLD


def test_seen_and_unseen_words_and_paths():
    """Trained without a quarter of the words and a quarter of the path shapes, tested on URLs of both."""
    words, found, bad = url_filter.seed_words(), [], []
    every = range(len(url_filter.WANTED_PATHS))
    for fold in range(4):
        model = url_filter.train(url_filter.seed_labels([w for i, w in enumerate(words) if i % 4 != fold], [k for k in every if k % 4 != fold]))
        held = url_filter.seed_labels([w for i, w in enumerate(words) if i % 4 == fold], [k for k in every if k % 4 == fold])
        found.append(blocked(model, held["url"]))
        bad.append(held["unwanted"].to_numpy() == 1)
    bad, found = np.concatenate(bad), np.concatenate(found)
    table = url_filter.seed_labels()
    own, unwanted = blocked(url_filter.train(table), table["url"]), table["unwanted"].to_numpy() == 1
    print(f"held out: recall {found[bad].mean():.3f}, false positives {found[~bad].mean():.3f}; seen: {own[unwanted].mean():.3f}, {own[~unwanted].mean():.3f}")
    assert found[bad].mean() >= 0.5 and found[~bad].mean() <= 0.03
    assert own[unwanted].mean() > 0.85 and own[~unwanted].mean() < 0.01


def test_paths_alone_tell():
    """Hosts of no known word: tracking and offers are blocked, ordinary pages aren't."""
    model = url_filter.train(url_filter.seed_labels())
    hosts, paths = zip(*map(url_filter.split_url, ["https://zqvkw.com/promo/free-zqvkw-bonus", "https://zqvkw.com/events/zqvkw/programme"]), strict=True)
    score = model.score(hosts, paths)
    assert score[0] > 0.5 > 0.2 > score[1]


def test_no_host_of_the_pages_is_a_seed():
    hosts = {url_filter.split_url(u)[0] for u in pd.read_parquet("/root/testdata/sf0.1/pages.parquet")["url"]}
    labels = {part for u in url_filter.seed_labels()["url"] for part in url_filter.split_url(u)[0].split(".")[:-1]}
    own = {part for h in hosts for part in h.split(".")} - {"example", "com", "org", "net", *(p[:-1] for p in url_filter.PREFIXES)}
    assert not own & labels
    model = url_filter.train(url_filter.seed_labels())
    print("share of the pages' hosts blocked:", blocked(model, [f"https://{h}/" for h in sorted(hosts)]).mean())
