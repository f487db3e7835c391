"""A bidirectional LSTM in numpy that labels every block of a page, and the layouts it learns from."""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np

from .html_blocks import MARK, WIDTH, Block, Element, blocks, vectors

HIDDEN = 24
#: Cells of one batch's input, so memory does not follow the longest page times the batch.
CELLS = 1 << 22
#: Blocks that one step of fitting goes back through; a longer page is fitted in such parts, one after the other.
STEPS = 1000

#: Names that tell what an element holds; they label the training pages' blocks, never the result.
MAIN = {"article", "main"}
OTHER = set(
    "nav header footer aside form ad ads advert sidebar menu comment comments cookie notice banner promo related share social "
    "breadcrumb breadcrumbs newsletter subscribe login search widget popup modal".split()
)


@dataclass
class Net:
    """Weights by name: f* and b* for the two directions, o* for the output."""

    w: dict[str, np.ndarray]

    @staticmethod
    def new(seed: int = 0, width: int = WIDTH, hidden: int = HIDDEN) -> Net:
        rng, w = np.random.default_rng(seed), {}
        for d in "fb":
            w[d + "x"] = (rng.standard_normal((width, 4 * hidden)) / np.sqrt(width)).astype(np.float32)
            w[d + "h"] = (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            w[d + "c"] = np.concatenate((np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden))).astype(np.float32)
        w["ow"] = (rng.standard_normal(2 * hidden) / np.sqrt(2 * hidden)).astype(np.float32)
        w["oc"] = np.zeros(1, np.float32)
        return Net(w)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(net: Net, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
    """States (T, B, H) of one direction; x is (T, B, D) already in reading order, mask (T, B, 1)."""
    steps, batch, _ = x.shape
    hidden = net.w[d + "h"].shape[0]
    pre = (x.reshape(-1, x.shape[2]) @ net.w[d + "x"] + net.w[d + "c"]).reshape(steps, batch, -1)
    h = c = np.zeros((batch, hidden), np.float32)
    out, tape = np.empty((steps, batch, hidden), np.float32), []
    for t in range(steps):
        z = pre[t] + h @ net.w[d + "h"]
        gates, g = _sigmoid(z[:, : 3 * hidden]), np.tanh(z[:, 3 * hidden :])
        i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
        new_c = f * c + i * g
        tc = np.tanh(new_c)
        new_h = o * tc
        if keep:
            tape.append((h, c, i, f, o, g, tc))
        h, c = mask[t] * new_h + (1 - mask[t]) * h, mask[t] * new_c + (1 - mask[t]) * c
        out[t] = h
    return out, tape


def _back(net: Net, d: str, x: np.ndarray, mask: np.ndarray, tape: list, upper: np.ndarray, grad: dict) -> None:
    steps, batch, hidden = upper.shape
    dz = np.zeros((steps, batch, 4 * hidden), np.float32)
    dh, dc = np.zeros((batch, hidden), np.float32), np.zeros((batch, hidden), np.float32)
    heads = np.empty((steps, batch, hidden), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, tc = tape[t]
        heads[t] = h
        dh = dh + upper[t]
        a, rest = mask[t] * dh, (1 - mask[t]) * dh
        ac = mask[t] * dc + a * o * (1 - tc**2)
        dz[t] = np.concatenate((ac * g * i * (1 - i), ac * c * f * (1 - f), a * tc * o * (1 - o), ac * i * (1 - g**2)), axis=1)
        dh, dc = rest + dz[t] @ net.w[d + "h"].T, (1 - mask[t]) * dc + ac * f
    flat = dz.reshape(-1, 4 * hidden)
    grad[d + "x"] = x.reshape(-1, x.shape[2]).T @ flat
    grad[d + "h"] = heads.reshape(-1, hidden).T @ flat
    grad[d + "c"] = flat.sum(axis=0)


def _pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pages as (T, B, D) forwards and backwards, and the mask: each page's blocks come first in both."""
    long = max(len(p) for p in pages)
    x = np.zeros((2, long, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((long, len(pages), 1), np.float32)
    for k, p in enumerate(pages):
        x[0, : len(p), k], x[1, : len(p), k], mask[: len(p), k] = p, p[::-1], 1
    return x[0], x[1], mask


def _turned(states: np.ndarray, pages: list[np.ndarray]) -> np.ndarray:
    out = np.zeros_like(states)
    for k, p in enumerate(pages):
        out[: len(p), k] = states[: len(p), k][::-1]
    return out


def label(net: Net, pages: list[np.ndarray]) -> list[np.ndarray]:
    """The probability of main text for every block of every page."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    while order:
        size = max(1, min(256, CELLS // (len(pages[order[-1]]) * WIDTH)))
        take, order = order[-size:], order[:-size]
        own = [pages[i] for i in take]
        x, y, mask = _pad(own)
        states = np.concatenate((_run(net, "f", x, mask, False)[0], _turned(_run(net, "b", y, mask, False)[0], own)), axis=2)
        p = _sigmoid(states @ net.w["ow"] + net.w["oc"])
        for k, i in enumerate(take):
            out[i] = p[: len(pages[i]), k]
    return out


def train(pages: list[tuple[np.ndarray, np.ndarray]], seed: int = 0, rounds: int = 6, batch: int = 32, rate: float = 0.01) -> Net:
    """Adam on the cross entropy of labelled blocks (label -1: not counted)."""
    net, rng = Net.new(seed), random.Random(seed)
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    pages, step = [p for p in pages if len(p[0])], 0
    for _ in range(rounds):
        pages.sort(key=lambda p: (len(p[0]) // 8, rng.random()))
        lots = [pages[i : i + batch] for i in range(0, len(pages), batch)]  # of STEPS blocks a page at most
        rng.shuffle(lots)
        for lot in lots:
            own = [p[0] for p in lot]
            x, y, mask = _pad(own)
            truth = np.full(mask.shape[:2], -1.0, np.float32)
            for k, p in enumerate(lot):
                truth[: len(p[1]), k] = p[1]
            fs, ft = _run(net, "f", x, mask, True)
            bs, bt = _run(net, "b", y, mask, True)
            states = np.concatenate((fs, _turned(bs, own)), axis=2)
            known = truth >= 0
            delta = np.where(known, _sigmoid(states @ net.w["ow"] + net.w["oc"]) - truth, 0) / max(1, known.sum())
            grad = {"ow": np.einsum("tbh,tb->h", states, delta), "oc": np.array([delta.sum()], np.float32)}
            upper = delta[:, :, None] * net.w["ow"]
            half = upper.shape[2] // 2
            _back(net, "f", x, mask, ft, upper[:, :, :half], grad)
            _back(net, "b", y, mask, bt, _turned(upper[:, :, half:], own), grad)
            step += 1
            for k, g in grad.items():
                g = np.clip(g, -1, 1).astype(np.float32)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                net.w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return net


def marked(page: str | None) -> list[Block]:
    """The page's blocks labelled by what their paths say: 1 inside an article, 0 inside other named parts (the
    nearest such element decides), -1 where nothing says."""
    out, known = blocks(page), {None: -1}

    def says(element: Element | None) -> int:
        open_ = []
        while element not in known:
            open_.append(element)
            element = element.above
        value = known[element]
        for e in reversed(open_):
            names = {e.name, *e.words}
            value = known[e] = 0 if names & OTHER else 1 if names & MAIN else value
        return value

    for b in out:
        b.main = says(b.inside)
    return out


def layouts(texts: list[str], others: list[str], count: int, seed: int = 0) -> list[str]:
    """Pages in many layouts around main texts and other texts, with each part's block marked by data-main.

    The names of containers vary, are often missing, and appear on the wrong side at times, so the labeller has
    to weigh path, words and surroundings together."""
    rng = random.Random(seed)
    few = lambda pool, a, b: [rng.choice(pool) for _ in range(rng.randint(a, b))]
    wrap = lambda tag, names, inner: f'<{tag}{" class=" + chr(34) + rng.choice(names) + chr(34) if names and rng.random() < 0.8 else ""}>{inner}</{tag}>'

    def menu(names: list[str], tag: str) -> str:
        links = [f'<a href="/{i}">{rng.choice(others).split()[0] if rng.random() < 0.7 else rng.choice(others)[:30]}</a>' for i in range(rng.randint(2, 8))]
        if rng.random() < 0.6:
            return wrap(tag, names, "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>")
        return wrap(tag, names, "<p>" + " | ".join(links) + "</p>" if rng.random() < 0.5 else "".join(f"<div>{x}</div>" for x in links))

    def side() -> str:
        kind = rng.randrange(7)
        if kind == 0:
            return wrap("div", ["comments", "comment-list", "user-comments", "responses"], "".join(
                wrap("div", ["comment", "reply", "comment-body"], f"<p>{t}</p>") for t in few(others + texts, 1, 5)))
        if kind == 1:
            return wrap(rng.choice(["aside", "div"]), ["sidebar", "side-bar", "widget", "related", "related-posts"], "".join(f"<h3>{t[:40]}</h3><p>{t}</p>" for t in few(others, 1, 3)))
        if kind == 2:
            return wrap("div", ["ad", "ads", "advert", "ad-slot", "sponsor", "promo"], rng.choice(others))
        if kind == 3:
            return wrap("div", ["cookie-notice", "notice", "consent", "banner", "alert"], f"<p>{rng.choice(others)}</p><button>OK</button>")
        if kind == 4:
            return f'<form{rng.choice(["", " class=newsletter", " id=search"])}><label>{rng.choice(others)[:30]}</label><input name=q><button>{rng.choice(others)[:12]}</button></form>'
        if kind == 5:
            return wrap("div", ["share", "social", "tags", "meta", "byline"], "".join(f'<a href="#">{t.split()[0]}</a> ' for t in few(others, 2, 5)))
        return menu(["menu", "links", "related-links", "breadcrumbs"], rng.choice(["div", "nav"]))

    out = []
    for _ in range(count):
        body = []
        if rng.random() < 0.8:
            body.append(f"<h{rng.randint(1, 2)}>{rng.choice(texts)[:60]}</h1>")
        for t in few(texts, 1, 12):
            r = rng.random()
            part = f"<h2>{t[:50]}</h2>" if r < 0.08 else f"<ul><li>{t}</li><li>{rng.choice(texts)}</li></ul>" if r < 0.14 else f"<blockquote>{t}</blockquote>" if r < 0.18 else f"<pre>{t}</pre>" if r < 0.2 else f"<div>{t}</div>" if r < 0.26 else f"<p><b>{t}<br><p>{rng.choice(texts)}</p>" if r < 0.36 else f'<p>{t[:40]} <a href="#">{t[40:55]}</a> {t[55:]}</p>' if r < 0.45 else f"<p>{t}</p>"
            body.append(part)
        inner = "".join(x if rng.random() < 0.93 else x + "</data-main>" + side() + "<data-main>" for x in body)
        tag = rng.choice(["article", "article", "main", "div", "div", "section", "td"])
        main = wrap(tag, ["post", "post-content", "entry", "entry-content", "story", "content", "article-body", "text", "page", "blog-post", "body-text"], f"<data-main>{inner}</data-main>")
        main = f"<table><tr>{main}</tr></table>" if tag == "td" else main
        above = [side() for _ in range(rng.randint(0, 3))]
        if rng.random() < 0.8:
            above.insert(0, wrap(rng.choice(["header", "div"]), ["header", "site-header", "top", "masthead"], f"<h1>{rng.choice(others)[:25]}</h1>" * (rng.random() < 0.6) + menu([], "div") * (rng.random() < 0.4)))
        if rng.random() < 0.8:
            above.insert(rng.randint(0, len(above)), menu(["nav", "menu", "navbar", "main-menu", "navigation"], rng.choice(["nav", "nav", "div"])))
        below = [side() for _ in range(rng.randint(0, 3))]
        if rng.random() < 0.85:
            below.append(wrap(rng.choice(["footer", "footer", "div"]), ["footer", "site-footer", "bottom", "copyright"], rng.choice([f"&copy; {rng.choice(others)}", f"<p>{rng.choice(others)} &middot; {rng.choice(others)}</p>", menu([], "div")])))
        page = "".join([*above, main, *below])
        out.append(f"<html><body>{wrap('div', ['wrapper', 'container', 'page', 'site'], page) if rng.random() < 0.4 else page}</body></html>")
    return out


def truth(page: str) -> list[Block]:
    """Blocks of a layout with their labels; the marks are no part of their paths."""
    out = blocks(page)
    for b in out:
        b.main = int(b.inside is not None and b.inside.marked)
    return out


def learn(pages: list[str | None], seed: int = 0, extra: int = 1200) -> Net:
    """A net fitted on the given pages, labelled by their own marks, and on extra layouts made of their texts."""
    own = [marked(p) for p in pages]
    texts = sorted({b.text for p in own for b in p if b.main == 1}) or ["Text of a page, in words."]
    others = sorted({b.text for p in own for b in p if b.main == 0}) or ["Menu"]
    made = [truth(p) for p in layouts(texts, others, extra, seed)]
    rows = [(vectors(p), np.array([b.main for b in p], np.float32)) for p in [*own, *made]]
    return train([(x[at : at + STEPS], y[at : at + STEPS]) for x, y in rows for at in range(0, len(x), STEPS)], seed)
