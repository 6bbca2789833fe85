"""A parsed page as a stream of items: where elements open and close, and texts.

An item knows its partner (the place where its element closes or opened), its parent and, for a few families of elements, the
nearest one around it (or itself): so what is inside what is a comparison of places, and sums over an element are differences
of running sums at its two places. Nothing is judged here.
"""

from __future__ import annotations

from gleaner.functions.html import BLOCK, Page

#: Attributes that rules look at.
ATTRIBUTES = ("id", "class", "role", "style", "aria-hidden", "contenteditable", "hidden", "itemprop", "itemtype", "type")
FAMILIES = {"block": BLOCK, "table": {"table"}, "link": {"a"}, "strong": {"b", "strong"}, "entry": {"li", "dd"}}
ITEM = "struct<tag: string, mate: int, parent: int, block: int, table: int, link: int, strong: int, entry: int, main: int, before: int, text: string, attributes: map<string, string>>"
ROOT, CLOSE = "#root", "/"


def items(page: Page) -> list[dict]:
    """tag: an element's name, '' for a text, '/' where an element closes. before: the nearest sibling before it that has text."""
    out: list[dict] = []
    place = [0] * len(page.tag)
    last: dict[int, int] = {}
    open_: list[int] = []

    def close() -> None:
        at = place[open_.pop()]
        out[at]["mate"] = len(out)
        out.append({"tag": CLOSE, "mate": at, "parent": out[at]["parent"]})

    for i, tag in enumerate(page.tag):
        while open_ and page.end[open_[-1]] <= i:
            close()
        place[i] = at = len(out)
        up = place[page.parent[i]] if i else -1
        around = out[up] if i else dict.fromkeys((*FAMILIES, "main"), -1)
        item = {"tag": tag or ("" if i else ROOT), "mate": at, "parent": up, "before": last.get(up, -1), "text": page.text[i], "main": around["main"]}
        item |= {name: at if tag in family else around[name] for name, family in FAMILIES.items()}
        if tag or not i:
            open_.append(i)
            if page.semantic(i):
                item["main"] = at
            if page.attrs[i]:
                item["attributes"] = {k: page.attrs[i][k] for k in ATTRIBUTES if k in page.attrs[i]}
        if page.size(i):
            last[up] = at
        out.append(item)
    while open_:
        close()
    return out
