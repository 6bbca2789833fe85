"""What holds a page back before anything of it is asked, and which kind of page it is: expressions on parsed pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.plans import values as V


def strings(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items]) if items else F.array().cast("array<string>")


def suffixes(host: Column) -> Column:
    """A host and the domains that it is part of."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def host_enabled(host: Column, allowed: list[str] = (), denied: list[str] = ()) -> Column:
    """A host is off if it or a domain of it is on a list; what the user allows comes first."""
    of = suffixes(host)
    return (host != "") & (F.arrays_overlap(of, strings(list(allowed))) | ~F.arrays_overlap(of, strings([*denied, *V.DENIED_HOSTS])))


def private_host(host: Column) -> Column:
    """Hosts inside a network only; a machine's own addresses are not meant."""
    own = host.isin("localhost", "127.0.0.1", "::1") | host.startswith("127.")
    inside = host.rlike(r"\.(local|internal|lan|intranet|corp|private|home\.arpa)$") | host.rlike(r"^(10(\.\d{1,3}){3}|192\.168(\.\d{1,3}){2}|169\.254(\.\d{1,3}){2}|172\.(1[6-9]|2\d|3[01])(\.\d{1,3}){2})$")
    return ~own & (~host.contains(".") & ~host.contains(":") | inside | host.rlike("^(f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)"))


def private_segment(path: Column) -> Column:
    """The first segment of the path that names a private area, or null."""
    bare = F.transform(F.split(F.lower(path), "/"), lambda x: F.regexp_replace(x, r"\.(html?|php|aspx?|jsp)$", ""))
    return F.get(F.filter(bare, lambda x: x.isin(V.PRIVATE_SEGMENTS)), 0)


def privacy() -> tuple[Column, Column]:
    """(level, reason): never, ask or null; the first sign that holds."""
    host, segment = F.col("host"), private_segment(F.col("path"))
    signs = [
        (F.col("never"), "never", F.lit("sign-in or payment page")),
        (private_host(host), "ask", F.lit("private-host")),
        (segment.isNotNull(), "ask", F.concat(F.lit("private-path:"), segment)),
        (F.col("personal_form"), "ask", F.lit("personal-form")),
        (F.col("unlisted"), "ask", F.when(F.col("signed_in"), "signed-in").otherwise("unlisted")),
    ]
    level = reason = F
    for test, how, why in signs:
        level, reason = level.when(test, F.lit(how)), reason.when(test, why)
    return level, reason


def status(mode: str = "auto", asked: bool = False, allowed: list[str] = (), denied: list[str] = (), always: list[str] = ()) -> tuple[Column, Column]:
    """(status, reason) of a parsed page: the first guard that fails names it; 'judging' if none does.

    asked: the user asked for this page; then run mode, privacy and account numbers hold nothing back, except pages that are
    never read.
    """
    host = F.col("host")
    level, reason = privacy()
    held = F.lit(not asked)
    sentences = F.size("sentences")
    withheld = F.size(F.filter("sentences", lambda s: s["withheld"]))
    guards = [
        (~host_enabled(host, allowed, denied), "disabled", F.lit("off on this site")),
        (F.coalesce(level == "never", F.lit(False)), "skipped", reason),
        (held & level.isNotNull(), "held", reason),
        (held & F.lit(mode == "click") & ~F.arrays_overlap(suffixes(host), strings(list(always))), "ready", F.lit(None).cast("string")),
        (F.col("app_like"), "skipped", F.lit("looks like an app")),
        (sentences < V.MIN_SENTENCES, "skipped", F.lit("too little text")),
        (held & (withheld >= V.STATEMENT_NUMBERS), "held", F.lit("account-numbers")),
    ]
    name = why = F
    for test, what, text in guards:
        name, why = name.when(test, F.lit(what)), why.when(test, text)
    return name.otherwise("judging"), why.otherwise(None)


def pack_scores() -> Column:
    """An array of (score, order, pack) with the score of each kind of page, by the signals of a parsed page."""
    host = F.col("host")
    path = F.concat(F.lit("/"), F.trim(F.lower("path"), F.lit("/")), F.lit("/"))

    def tests(kind: str, patterns: list[str]) -> Column:
        if kind == "jsonld":
            return F.arrays_overlap("json_ld_types", strings(patterns))
        if kind == "og":
            return F.coalesce(F.lower("og_type").isin(patterns), F.lit(False))
        if kind == "path":
            return F.exists(strings(patterns), lambda x: F.contains(path, F.concat(F.lit("/"), x, F.lit("/"))))
        return F.exists(strings(patterns), lambda x: F.when(x.endswith("."), F.startswith(host, x)).otherwise((host == x) | F.endswith(host, F.concat(F.lit("."), x))))

    def score(signals: dict[str, list[str]], hay: Column) -> Column:
        total = F.lit(0.0)
        for kind, patterns in signals.items():
            if kind == "cue":
                found = F.size(F.filter(strings(patterns), lambda x: F.contains(hay, x)))
                total = total + F.least(F.lit(V.CUE_CAP), found * V.WEIGHTS["cue"])
            else:
                total = total + F.when(tests(kind, patterns), V.WEIGHTS[kind]).otherwise(0.0)
        return F.round(F.least(F.lit(1.0), total), 6)

    def scores(hay: Column) -> Column:
        return F.array(*[F.struct(score(signals, hay).alias("score"), F.lit(-order).alias("order"), F.lit(name).alias("pack")) for order, (name, signals) in enumerate(V.PACKS)])

    # a lambda's argument is worked out once, not again for each cue
    return F.get(F.transform(F.array(F.lower(F.concat_ws("\n", "title", "sample"))), scores), 0)


def routed() -> Column:
    """The kind of page: the highest score, the earlier pack at a tie, 'other' below the threshold."""
    best = F.array_max(pack_scores())
    return F.when(best["score"] >= V.ROUTE_AT, best["pack"]).otherwise("other")
