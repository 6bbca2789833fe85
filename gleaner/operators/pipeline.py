"""Pages to judged sentences.

One row a page until its sentences are cut into requests, one row a request until its answers are read: guards, chunks,
states, questions and answers are expressions on arrays, so that a page passes from the scan to its judgment without a shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import html as H
from gleaner.functions import sqltext as X
from gleaner.functions.columns import running, staged
from gleaner.functions.hashes import fnv1a
from gleaner.functions.sentences import split
from gleaner.operators import cached, guards, highlights
from gleaner.operators.evaluate import variant_states
from gleaner.operators.judge import Judge, StubJudge, ask, by_rows
from gleaner.operators.settings import distinct_rules
from gleaner.plans import values as V
from gleaner.plans.dialect import Spark
from gleaner.plans.sql import account
from gleaner.sources.pages import content_hash, pages, parsed, spread

KEEP = "Would a reader miss this sentence? "
KIND = "Why could a reader skip this sentence? "
PAGE_KIND = "What kind of page is this?"
#: What counts as substance on a kind of page, added to the question.
PACK_HINTS = {
    "recipe": "Amounts, times and steps count.",
    "legal": "Duties, rights, limits and dates count.",
    "corporate": "What changed, for whom and when counts.",
    "product": "Properties, prices and limits count.",
    "docs": "Usage, parameters and results count.",
    "paper": "Claims, methods, figures and results count.",
    "article": "Facts, figures and statements of people count.",
    "social": "What is told counts, calls to react do not.",
}


def question(key: Column, kind: str, text: Column, options: list[str] | None = None) -> Column:
    allowed = guards.strings(options) if options else F.lit(None).cast("array<string>")
    return F.struct(key.alias("key"), F.lit(kind).alias("type"), text.alias("text"), allowed.alias("options"))


def chunks(sentences: Column, size: int) -> Column:
    """Balanced contiguous chunks: an array of (chunk, sentences), larger chunks first, none without sentences."""
    n = F.size(sentences)
    count = F.ceil(n / size).cast("int")
    base, extra = F.floor(n / count).cast("int"), n % count

    def one(k: Column) -> Column:
        return F.struct(k.alias("chunk"), F.slice(sentences, k * base + F.least(k, extra) + 1, base + (k < extra).cast("int")).alias("part"))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), one))


def requests(found: DataFrame, size: int = V.PER_REQUEST, name: str = "r") -> DataFrame:
    """``found`` (pages with ``sentences`` and ``pack``) by request: chunk, part (its sentences), request_id and state.

    Withheld sentences and the page's address are in no request; a page without sendable sentences keeps one row without any.
    """
    sendable = F.filter("sentences", lambda s: ~s["withheld"])
    cut = found.withColumn("sendable", sendable).select("*", F.explode_outer(chunks(F.col("sendable"), size)).alias("cut")).drop("sendable", "sentences")
    text = F.array_join(F.transform("cut.part", lambda s: s["text"]), " ")
    state = F.to_json(F.struct(F.col("pack").alias("page_kind_hint"), "title", F.col("lang").alias("language"), text.alias("text")))
    request_id = F.concat_ws("/", F.lit(name), "page_id", "cut.chunk")
    return cut.select("*", F.col("cut.chunk").alias("chunk"), F.coalesce("cut.part", F.array().cast(dict(cut.dtypes)["cut"].partition("part:")[2][:-1])).alias("part"), request_id.alias("request_id"), state.alias("state")).drop("cut")


def answer(place: Column) -> Column:
    """The answer to the question at a place of a request, or null."""
    return F.get("answers", place)


def keyed(prefix: str, sent_id: Column) -> Column:
    return F.concat(F.lit(prefix), sent_id.cast("string"))


def judged(found: DataFrame, judge: Judge, size: int = V.PER_REQUEST) -> DataFrame:
    """By request: judgments (sent_id, keep, kind, kind_conf, failed) of its sentences, page_kind and its confidence (first request), error, tokens.

    A sentence needs both its answers, else it has failed; a probability is cut to 0..1.
    """
    hint = F.try_element_at(F.create_map(*[F.lit(x) for pair in PACK_HINTS.items() for x in pair]), F.col("pack"))
    asked = requests(found, size)
    each = F.transform("part", lambda s: F.array(question(keyed("keep_", s["sent_id"]), "noul", F.concat_ws(" ", F.lit(KEEP.strip()), hint, s["text"])), question(keyed("kind_", s["sent_id"]), "choice", F.concat(F.lit(KIND), s["text"]), V.KINDS)))
    about_page = F.when(F.col("chunk") == 0, F.array(question(F.lit("page_kind"), "choice", F.concat(F.lit(PAGE_KIND + " "), F.col("state")), V.PAGE_KINDS))).otherwise(F.slice(F.flatten(each), 1, 0))
    got = ask(asked.withColumn("questions", F.concat(F.flatten(each), about_page)), judge)

    def judgment(s: Column, i: Column) -> Column:
        keep, kind = answer(2 * i)["p"], answer(2 * i + 1)
        good = keep.isNotNull() & ~F.isnan(keep) & F.coalesce(kind["label"].isin(V.KINDS), F.lit(False))
        keep = F.greatest(F.lit(0.0), F.least(F.lit(1.0), keep))
        return F.struct(s["sent_id"].alias("sent_id"), F.when(good, keep).alias("keep"), F.when(good, kind["label"]).alias("kind"), F.when(good, F.coalesce(kind["confidence"], F.lit(0.0))).alias("kind_conf"), F.coalesce(~good, F.lit(True)).alias("failed"))

    page = answer(2 * F.size("part"))
    known = F.coalesce(page["label"].isin(V.PAGE_KINDS), F.lit(False))
    kind = F.when(F.col("chunk") == 0, F.when(known, page["label"]).otherwise(F.col("pack")))
    return got.select("*", F.transform("part", judgment).alias("judgments"), kind.alias("page_kind"), F.when(F.col("chunk") == 0, F.when(known, F.coalesce(page["confidence"], F.lit(0.0))).otherwise(0.0)).alias("page_kind_conf")).drop("answers", "questions", "part", "state")


def guarded(scanned: DataFrame, **rules) -> DataFrame:
    """Parsed pages with status, reason and pack; only pages with the status 'judging' keep their sentences."""
    status, reason = guards.status(**rules)
    found = parsed(scanned).withColumn("status", status).withColumn("reason", reason).withColumn("pack", guards.routed())
    count = F.size("sentences")
    kept = F.when(F.col("status") == "judging", F.col("sentences")).otherwise(F.slice("sentences", 1, 0))
    return found.withColumn("n_sentences", count).withColumn("capped", count >= V.MAX_SENTENCES).withColumn("sentences", kept)


def judge_pages(found: DataFrame, judge: Judge, size: int = V.PER_REQUEST) -> DataFrame:
    """(page_id, sent_id, keep, kind, kind_conf, failed) of every sendable sentence."""
    return judged(found, judge, size).select("page_id", F.explode("judgments").alias("j")).select("page_id", "j.*")


def page_reports(found: DataFrame, judge: Judge, threshold: float = V.KEEP_AT, size: int = V.PER_REQUEST) -> DataFrame:
    """One row a page: its status and reason, its kind, and how many sentences are kept, faded and failed."""
    j = judged(found, judge, size)

    def count(test) -> Column:
        return F.sum(F.size(F.filter("judgments", test)))

    out = j.groupBy("page_id").agg(
        F.first("status").alias("status"), F.first("reason").alias("reason"), F.first("pack").alias("pack"), F.max("page_kind").alias("page_kind"), F.max("page_kind_conf").alias("page_kind_conf"),
        count(lambda x: ~x["failed"]).alias("total"), count(lambda x: ~x["failed"] & (x["keep"] >= threshold)).alias("kept"), count(lambda x: ~x["failed"] & (x["keep"] < threshold)).alias("faded"),
        count(lambda x: x["failed"]).alias("failed"), F.sum("tokens").alias("tokens"), F.first("error", ignorenulls=True).alias("error"), F.first("capped").alias("capped"),
    )
    # all requests failed: the page shows the error; a page that was not asked about has no kind
    broken = (F.col("status") == "judging") & (F.col("total") == 0)
    status = F.when(broken, "error").when(F.col("status") == "judging", "done").otherwise(F.col("status"))
    reason = F.when(broken, F.when(F.col("error") == "timeout", "network").otherwise(F.coalesce("error", F.lit("no answers")))).otherwise(F.col("reason"))
    return out.withColumn("reason", reason).withColumn("status", status).withColumn("page_kind", F.when(F.col("status") == "done", F.col("page_kind"))).drop("error")


def rule_chunk_size(rules: int, size: int = V.PER_REQUEST) -> int:
    """So many sentences that a request has about as many questions as one about keeping."""
    return max(1, min(size, 2 * size // max(1, rules)))


def judge_rules(found: DataFrame, rules: list[str], judge: Judge, size: int = V.PER_REQUEST) -> DataFrame:
    """(page_id, sent_id, rule, rule_order, p) for the user's rules (normalised: distinct, the first few that count).

    A missing answer leaves its pair out; a sentence without any answer is told by one row with a null rule.
    """
    asked = distinct_rules(rules, V.MAX_RULES)
    return scored(found, asked, judge, rule_chunk_size(len(asked), size), "Is this about {}? ").select("page_id", "sent_id", F.col("item").alias("rule"), F.col("item_order").alias("rule_order"), "p")


def scored(found: DataFrame, items: list[str], judge: Judge, size: int, wording: str) -> DataFrame:
    """(page_id, title, lang, pack, sent_id, text, item, item_order, p): a probability for each item and sentence."""
    numbered = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(x).alias("item"), F.lit(wording.format(x)).alias("head")) for i, x in enumerate(items)])
    if not items:
        found = found.limit(0)
        numbered = F.array(F.struct(F.lit(0).alias("n"), F.lit("").alias("item"), F.lit("").alias("head")))

    def key(n: Column, s: Column) -> Column:
        return F.concat_ws("_", F.lit("rule"), n, s["sent_id"])

    each = F.flatten(F.transform(numbered, lambda x: F.transform("part", lambda s: question(key(x["n"], s), "noul", F.concat(x["head"], s["text"])))))
    got = ask(requests(found, size).withColumn("questions", each), judge)
    none = F.struct(F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("item"), F.lit(None).cast("double").alias("p"))

    def found_for(s: Column, i: Column) -> Column:
        got = F.filter(F.transform(numbered, lambda x: F.struct(x["n"].alias("n"), x["item"].alias("item"), answer(x["n"] * F.size("part") + i)["p"].alias("p"))), lambda x: x["p"].isNotNull())
        return F.transform(F.when(F.size(got) > 0, got).otherwise(F.array(none)), lambda x: F.struct(s["sent_id"].alias("sent_id"), s["text"].alias("text"), x["n"].alias("n"), x["item"].alias("item"), x["p"].alias("p")))

    rows = got.select("page_id", "title", "lang", "pack", F.explode(F.flatten(F.transform("part", found_for))).alias("x"))
    return rows.select("page_id", "title", "lang", "pack", "x.sent_id", "x.text", "x.item", F.col("x.n").alias("item_order"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "x.p")).alias("p"))


def judge_highlights(found: DataFrame, terms: list[str], judge: Judge, units: dict[str, str] | None = None, size: int = V.PER_REQUEST) -> DataFrame:
    """(page_id, sent_id, term, start, end): what of a sentence says a term, in two rounds: which sentences, then where."""
    asked = distinct_rules(terms, V.MAX_HIGHLIGHTS)
    known = dict(units or {})
    known |= highlights.learned_units(found.sparkSession, [t for t in asked if t not in known], judge)
    gate = scored(found, asked, judge, rule_chunk_size(len(asked), size), "Does this say anything of {}? ")
    return highlights.located(gate, known, judge)


def q_page_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(pages(spark, sf_dir)).select("page_id", F.explode("sentences").alias("s")).select("page_id", "s.*")


def q_page_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guarded(pages(spark, sf_dir)).select("page_id", "status", "reason", "pack", "n_sentences", "capped", "json_ld_types", "og_type")


def q_judge_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(guarded(pages(spark, sf_dir)), StubJudge())


def q_page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_reports(guarded(pages(spark, sf_dir)), StubJudge())


def q_judge_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_rules(guarded(pages(spark, sf_dir)), ["prices", "dates"], StubJudge())


def q_judge_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_highlights(guarded(pages(spark, sf_dir)), ["costs", "names"], StubJudge())


def q_page_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages judged twice through one cache: what each run had to ask. The second asks nothing."""
    store = cached.page_store(spark, f"{cached.shared_folder(spark)}/page-cache-{uuid.uuid4().hex}")
    found = guarded(pages(spark, sf_dir)).checkpoint()
    runs = [cached.counts(cached.judge_cached(found, StubJudge(), store, tick, capacity=2**31 - 1)) for tick in (1, 2)]
    second = runs[1].select(F.col("page_id").alias("again"), F.col("cached").alias("hit_again"), F.col("requests").alias("requests_again"))
    return runs[0].join(second, F.col("page_id").eqNullSafe(F.col("again"))).select("page_id", "requests", (F.col("kept") + F.col("faded")).alias("answered"), "failed", "hit_again", "requests_again")


def q_page_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_hash(parsed(pages(spark, sf_dir))).select("page_id", "content_hash")


def q_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", fnv1a(X.col("text")).column().alias("content_hash"))


def q_document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sentences, cut where they are read."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(split(X.col("text")).column()).alias("sent_id", "sentence"))


def q_page_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages whose lines are blocks: how many blocks and sentences stay under the cap, which falls between blocks."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("page_id"), "text"))
    lines = X.filter(X.call("split", X.col("text"), "\n"), lambda x: x != "")
    df = staged(docs, sizes=X.transform(lines, lambda x: X.size(split(x)).cast("bigint"))).drop("text").where("size(sizes) > 0")
    df = staged(df, upto=running(X.col("sizes"), X.lit(0).cast("bigint")))
    kept = X.filter(X.sequence(0, X.size(X.col("sizes")) - 1), lambda i: X.coalesce(X.get(X.col("upto"), i - 1), 0) < V.MAX_SENTENCES)
    df = staged(df, blocks=X.size(kept).cast("bigint"))
    return df.select("page_id", "blocks", F.get("upto", (F.col("blocks") - 1).cast("int")).alias("sentences"))


def q_document_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where(F.col("text").rlike("[0-9]"))
    return docs.where(account(Spark())).select("doc_id")


def q_sentence_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON line a sentence, with its block and the heading that it stands under."""

    def work(rows: list[dict]) -> list[dict]:
        out = []
        for row in rows:
            page = H.Page(row["html"] or "")
            heads = H.headings(page, H.blocks(page))
            out += [{"page_id": row["page_id"], "sent_id": s[0], "block_id": s[1], "heading": heads[s[1]], "text": s[2]} for s in H.page_sentences(page)]
        return out

    found = by_rows(pages(spark, sf_dir).select("page_id", "html"), work, "page_id long, sent_id int, block_id int, heading string, text string")
    return found.select("page_id", F.to_json(F.struct("sent_id", "block_id", "heading", "text")).alias("line"))


def q_variant_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_states(pages(spark, sf_dir)).select("page_id", "variant", "chunk", F.to_json("state").alias("state"))


QUERIES = {
    "page_sentences": q_page_sentences,
    "page_guards": q_page_guards,
    "judge_page": q_judge_page,
    "page_report": q_page_report,
    "judge_rules": q_judge_rules,
    "judge_highlights": q_judge_highlights,
    "page_cache": q_page_cache,
    "page_cap": q_page_cap,
    "page_content_hash": q_page_content_hash,
    "content_hash": q_content_hash,
    "document_sentences": q_document_sentences,
    "document_accounts": q_document_accounts,
    "sentence_dump": q_sentence_dump,
    "variant_states": q_variant_states,
}
STEP = "CAST(xor(h, c) * 1099511628211::UHUGEINT % 18446744073709551616::UHUGEINT AS UHUGEINT)"
ORACLES = {
    "content_hash": f"SELECT item_id, lower(lpad(to_hex(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(text, ''), lambda x: CAST(unicode(x) AS UHUGEINT))), lambda h, c: {STEP})), 16, '0')) AS content_hash FROM benchmark",
}
