"""Lexicon sentiment, the hybrid score and what follows from it.

The lexicon score is row-local: every ticket is scored from its own word array, so scoring is one narrow
stage without a shuffle whatever the table size. For a lexicon too large to ship with the plan there is a
join form with the same result.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions import text as tx
from ticketlens.functions.wordlists import (
    BOOSTERS_DOWN, BOOSTERS_UP, EMOTICONS, LEXICON, NEGATIONS, PHRASE_BOOSTS, PHRASE_NEGATIONS, PHRASE_VALENCES, PHRASES_WITHOUT_EFFECT,
)
from ticketlens.operators.entities import without_overlaps
from ticketlens.operators.keywords import keyword_table_matches
from ticketlens.session import materialise, small_table

# --- Fixed values: weights of the lexicon rules ---------------------------------------
BOOST = 0.293
BOOST_DAMPING = (1.0, 0.95, 0.9)
CAPS = 0.733
NEGATE = -0.74
EXCLAMATION, EXCLAMATION_MAX = 0.292, 4
QUESTION, QUESTION_CAP = 0.18, 0.96
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
NORM_ALPHA = 15.0

# --- Fixed values: hybrid score -------------------------------------------------------
HYBRID_ALPHA = 0.4
LABEL_CUT = 0.15
CRITICAL_BELOW = -0.7

SCORES = ("lex_pos", "lex_neg", "lex_neu", "lex_compound")


def _is_upper(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word))


def _is_negation(word: Column, negations: Iterable[str]) -> Column:
    return word.isin(list(negations)) | F.contains(word, F.lit("n't"))


def _boost(word: Column, more: Mapping[str, float] | None = None) -> Column:
    out = F.when(word.isin(list(BOOSTERS_UP)), F.lit(BOOST)).when(word.isin(list(BOOSTERS_DOWN)), F.lit(-BOOST))
    for token, amount in (more or {}).items():
        out = out.when(word == token, F.lit(amount))
    return out.otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Phrases:
    """Runs of words that count as one: by valence, as degree words, as negations, or without effect; and emoticons by valence. Words of a phrase
    are joined by underscores in its token. All keys are in lower case but emoticons."""

    valences: Mapping[str, float] = field(default_factory=dict)
    boosts: Mapping[str, float] = field(default_factory=dict)
    negations: tuple[str, ...] = ()
    neutral: tuple[str, ...] = ()
    emoticons: Mapping[str, float] = field(default_factory=dict)

    def all(self) -> list[tuple[str, ...]]:
        return [tuple(p.split()) for p in (*self.valences, *self.boosts, *self.negations, *self.neutral)]

    @staticmethod
    def token(phrase: str) -> str:
        return "_".join(phrase.split())


PHRASES = Phrases(PHRASE_VALENCES, PHRASE_BOOSTS, PHRASE_NEGATIONS, PHRASES_WITHOUT_EFFECT, EMOTICONS)


def _trie(phrases: list[tuple[str, ...]]) -> tuple[dict[str, int], list[int]]:
    """Steps ``"node word"`` to the next node, from node 0, and the nodes at which a phrase ends."""
    steps: dict[str, int] = {}
    ends = []
    for words in phrases:
        node = 0
        for w in words:
            node = steps.setdefault(f"{node} {w}", len(steps) + 1)
        ends.append(node)
    return steps, ends


def merge_phrases(words: Column, lower: Column, phrases: list[tuple[str, ...]]) -> Column:
    """The word array with every phrase as one word, joined by underscores: from left to right, at each place the longest one.

    Only words that begin a phrase start a walk through the trie, which goes on as long as the next words are on a path.
    """
    steps, ends = _trie(phrases)
    table = F.from_json(F.lit(json.dumps(steps)), "map<string,int>")
    heads, longest = sorted({p[0] for p in phrases}), max(map(len, phrases))

    def walk(at: Column) -> Column:
        def step(s: Column, w: Column) -> Column:
            node = F.when(s["node"] >= 0, F.coalesce(F.try_element_at(table, F.concat_ws(" ", s["node"].cast("string"), w)), F.lit(-1))).otherwise(F.lit(-1))
            depth = s["depth"] + 1
            return F.struct(node.alias("node"), depth.alias("depth"), F.when(node.isin(ends), depth).otherwise(s["best"]).alias("best"))

        start = F.struct(F.lit(0).alias("node"), F.lit(0).alias("depth"), F.lit(0).alias("best"))
        return F.aggregate(F.slice(lower, at + 1, F.lit(longest)), start, step, lambda s: s["best"])

    begins = F.filter(F.transform(lower, lambda w, i: F.when(w.isin(heads), i)), lambda i: i.isNotNull())
    found = F.transform(begins, lambda i: F.struct(F.lit("").alias("text"), F.lit("").alias("label"), i.alias("start"), (i + walk(i)).alias("end")))

    def merged(kept: Column) -> Column:
        def part(k: Column, j: Column) -> Column:
            before = F.when(j > 0, F.get(kept, j - 1)["end"]).otherwise(F.lit(0))
            return F.concat(F.slice(words, before + 1, k["start"] - before), F.array(F.array_join(F.slice(words, k["start"] + 1, k["end"] - k["start"]), "_")))

        last = F.get(kept, F.size(kept) - 1)["end"]
        return F.when(F.size(kept) == 0, words).otherwise(F.concat(F.flatten(F.transform(kept, part)), F.slice(words, last + 1, F.greatest(F.size(words) - last, F.lit(0)))))

    spans = without_overlaps(F.filter(found, lambda m: m["end"] > m["start"]))
    return F.get(F.transform(F.array(spans), merged), F.lit(0))


def _signed(value: Column, amount: float) -> Column:
    return F.when(value > 0, F.lit(amount)).otherwise(F.lit(-amount))


def with_words(df: DataFrame, text_col: str, phrases: Phrases | None = None) -> DataFrame:
    """Word array, its lower-cased form, and whether some but not all words are in capitals. Phrases and emoticons are words."""
    text = tx.fill_text(F.col(text_col))
    pattern = tx.WORD_PATTERN
    if phrases is not None and phrases.emoticons:
        signs = "|".join("\\Q" + e + "\\E" for e in sorted(phrases.emoticons, key=lambda e: (-len(e), e)))
        pattern = f"(?:(?<=^| )(?:{signs})(?= |$))|{pattern}"
    df = df.withColumn("_words", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    if phrases is not None and phrases.emoticons:  # a capital in an emoticon is no shout
        df = df.withColumn("_words", F.transform("_words", lambda w: F.when(w.isin(list(phrases.emoticons)), F.lower(w)).otherwise(w)))
    if phrases is not None and phrases.all():
        df = df.withColumn("_words", merge_phrases(F.col("_words"), F.transform("_words", F.lower), phrases.all()))
    df = df.withColumn("_lower", F.transform("_words", F.lower)).withColumn("_n", F.size("_words"))
    capitals = F.size(F.filter("_words", _is_upper))
    return df.withColumn("_caps", (capitals > 0) & (capitals < F.col("_n"))).withColumn(
        "_but", F.array_position("_lower", "but")
    )


def _emphasis(text_col: str) -> Column:
    text = tx.fill_text(F.col(text_col))
    marks = F.least(F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))), F.lit(EXCLAMATION_MAX))
    questions = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    asked = (
        F.when(questions <= 1, F.lit(0.0))
        .when(questions <= 3, questions * QUESTION)
        .otherwise(F.lit(QUESTION_CAP))
    )
    return marks * EXCLAMATION + asked


def _step(value: Column, k: int | Column, damping: Column, previous: Column, lower: Column, known: Column, caps: Column, negations, boosts=None):
    """Effect of the word k places back: first its boost, then its negation."""
    boost = _boost(lower, boosts)
    boost = F.when(value < 0, -boost).otherwise(boost)
    boost = F.when(boost == 0, F.lit(0.0)).otherwise(
        (boost + F.when(caps & _is_upper(previous), _signed(value, CAPS)).otherwise(F.lit(0.0))) * damping
    )
    flipped = F.when(_is_negation(lower, negations), F.lit(NEGATE)).otherwise(F.lit(1.0))
    return F.when(lower.isNull() | known, value).otherwise((value + boost) * flipped)


def _but_weight(index: Column, but: Column) -> Column:
    return (
        F.when(but == 0, F.lit(1.0))
        .when(index + 1 < but, F.lit(BEFORE_BUT))
        .when(index + 1 > but, F.lit(AFTER_BUT))
        .otherwise(F.lit(1.0))
    )


def _finish(df: DataFrame, total: Column, pos: Column, neg: Column, n_opinion: Column, emphasis: Column) -> DataFrame:
    """Totals to the four scores. The sum is rounded so that its sign does not hang on the order of adding."""
    df = df.withColumn("_s", F.round(total, 6)).withColumn("_e", emphasis)
    df = df.withColumn("_p", F.round(pos, 6)).withColumn("_m", F.round(neg, 6)).withColumn("_k", n_opinion)
    s = F.when(F.col("_s") > 0, F.col("_s") + F.col("_e")).when(F.col("_s") < 0, F.col("_s") - F.col("_e")).otherwise(F.lit(0.0))
    df = df.withColumn("_s", s)
    df = df.withColumn("_pe", F.when(F.col("_p") > F.col("_m"), F.col("_p") + F.col("_e")).otherwise(F.col("_p")))
    df = df.withColumn("_me", F.when(F.col("_m") > F.col("_p"), F.col("_m") + F.col("_e")).otherwise(F.col("_m")))
    neutral = (F.col("_n") - F.col("_k")).cast("double")
    df = df.withColumn("_t", F.col("_pe") + F.col("_me") + neutral)

    def share(part: Column) -> Column:
        return F.when(F.col("_t") > 0, F.round(part / F.col("_t"), 3)).otherwise(F.lit(0.0))

    compound = F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + NORM_ALPHA)
    return df.withColumns(
        {
            "lex_pos": share(F.col("_pe")),
            "lex_neg": share(F.col("_me")),
            "lex_neu": share(neutral),
            "lex_compound": F.round(compound, 4),
        }
    )


def lexicon_sentiment(
    df: DataFrame,
    text_col: str = "clean",
    lexicon: Mapping[str, float] | None = None,
    negations: Iterable[str] = NEGATIONS,
    phrases: Phrases | None = None,
) -> DataFrame:
    """Add lex_pos, lex_neg, lex_neu and lex_compound for a cleaned text column, row by row in the JVM.

    The lexicon is a mapping and becomes part of the plan; one that is kept as a table goes to ``lexicon_join_sentiment``. ``phrases`` makes
    runs of words and emoticons count as one word each (``PHRASES`` is a default table); without it, words are scored one by one.
    """
    lexicon = LEXICON if lexicon is None else lexicon
    boosters = {*BOOSTERS_UP, *BOOSTERS_DOWN}
    boosts: dict[str, float] = {}
    if phrases is not None:
        token = phrases.token
        lexicon = {**lexicon, **{token(p): v for p, v in phrases.valences.items()}, **{e.lower(): v for e, v in phrases.emoticons.items()}}
        boosts = {token(p): b for p, b in phrases.boosts.items()}
        boosters |= boosts.keys()
        negations = (*negations, *map(token, phrases.negations))
    opinion_words = [w for w in lexicon if w not in boosters]
    levels: dict[float, list[str]] = {}
    for word in opinion_words:
        levels.setdefault(float(lexicon[word]), []).append(word)

    def valence(word: Column) -> Column:
        out = None
        for level, words in levels.items():
            out = (F.when if out is None else out.when)(word.isin(words), F.lit(level))
        return out

    original = df.columns
    df = with_words(df, text_col, phrases)
    # One set look-up for every word; only the few hits go on.
    spots = F.filter(
        F.transform("_lower", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda s: s["w"].isin(opinion_words)
    )

    def base(s: Column) -> Column:
        return F.struct(
            s["i"].alias("i"),
            (F.col("_caps") & _is_upper(F.get("_words", s["i"]))).alias("loud"),
            valence(s["w"]).alias("v"),
        )

    def context(s: Column) -> Column:
        start = s["v"] + F.when(s["loud"], _signed(s["v"], CAPS)).otherwise(F.lit(0.0))
        steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(d).alias("d")) for k, d in zip((1, 2, 3), BOOST_DAMPING)])
        return F.aggregate(
            steps,
            start,
            lambda v, step: _step(
                v,
                step["k"],
                step["d"],
                F.get("_words", s["i"] - step["k"]),
                F.get("_lower", s["i"] - step["k"]),
                F.coalesce(F.get("_lower", s["i"] - step["k"]).isin(list(lexicon)), F.lit(False)),
                F.col("_caps"),
                negations,
                boosts,
            ),
        ) * _but_weight(s["i"], F.col("_but"))

    df = df.withColumn("_spots", spots)
    df = df.withColumn("_hits", F.transform(F.transform("_spots", base), context))

    def fold(term) -> Column:
        return F.aggregate("_hits", F.lit(0.0), lambda acc, v: acc + term(v))

    zero = F.lit(0.0)
    scored = _finish(
        df,
        fold(lambda v: v),
        fold(lambda v: F.when(v > 0, v + 1).otherwise(zero)),
        fold(lambda v: F.when(v < 0, 1 - v).otherwise(zero)),
        F.size(F.filter("_hits", lambda v: v != 0)),
        _emphasis(text_col),
    )
    # Scores leave through a generator: a filter on a score stays above it instead of being rewritten into a
    # copy of the whole computation below.
    return scored.select(*original, F.inline(F.array(F.struct(*SCORES))))


def lexicon_join_sentiment(
    df: DataFrame, lexicon: DataFrame, id_col: str = "ticket_id", text_col: str = "clean", negations: Iterable[str] = NEGATIONS
) -> DataFrame:
    """(id, scores) for a lexicon table (token, valence) of any size.

    Words are exploded with their three predecessors beside them, so the context needs no window. Both
    look-ups are equi-joins that Spark broadcasts or shuffles by size; sums per ticket are combined before
    the shuffle.
    """
    lexicon = lexicon.select(F.lower("token").alias("token"), F.col("valence").cast("double").alias("valence"))
    words = with_words(df.select(id_col, text_col), text_col).withColumn("_e0", _emphasis(text_col))

    def around(w: Column, i: Column) -> Column:
        fields = [i.alias("i"), F.get("_words", i).alias("w0"), w.alias("l0")]
        for k in (1, 2, 3):
            fields += [F.get("_words", i - k).alias(f"w{k}"), F.get("_lower", i - k).alias(f"l{k}")]
        return F.struct(*fields)

    # The outer form keeps the optimizer from testing the array before it is taken apart, by building it twice.
    rows = words.withColumn("_at", F.transform("_lower", around)).select(
        id_col, "_n", "_caps", "_but", "_e0", F.inline_outer("_at")
    )
    hit = lexicon.join(
        small_table(lexicon.sparkSession, [(w,) for w in (*BOOSTERS_UP, *BOOSTERS_DOWN)], "token string"), "token", "left_anti"
    ).withColumnRenamed("token", "l0")
    hits = rows.join(hit, "l0")
    for k in (1, 2, 3):
        known = lexicon.select(F.col("token").alias(f"l{k}"), F.lit(True).alias(f"known{k}"))
        hits = hits.join(known, f"l{k}", "left")
    value = F.col("valence") + F.when(F.col("_caps") & _is_upper(F.col("w0")), _signed(F.col("valence"), CAPS)).otherwise(F.lit(0.0))
    hits = hits.withColumn("v", value)
    for k, damping in zip((1, 2, 3), BOOST_DAMPING):
        hits = hits.withColumn(
            "v",
            _step(
                F.col("v"), k, F.lit(damping), F.col(f"w{k}"), F.col(f"l{k}"),
                F.coalesce(f"known{k}", F.lit(False)), F.col("_caps"), negations,
            ),
        )
    v = F.col("v")
    sums = (
        hits.withColumn("v", v * _but_weight(F.col("i"), F.col("_but")))
        .groupBy(id_col)
        .agg(
            F.sum("v").alias("_sum"),
            F.sum(F.when(v > 0, v + 1).otherwise(F.lit(0.0))).alias("_pos"),
            F.sum(F.when(v < 0, 1 - v).otherwise(F.lit(0.0))).alias("_neg"),
            F.count_if(v != 0).alias("_hit"),
        )
    )
    joined = words.select(id_col, "_n", "_e0").join(sums, id_col, "left")

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))

    scored = _finish(joined, filled("_sum"), filled("_pos"), filled("_neg"), F.coalesce("_hit", F.lit(0)), F.col("_e0"))
    return scored.select(id_col, *SCORES)


def hybrid_score(
    df: DataFrame,
    compound: str = "lex_compound",
    model_label: str = "model_label",
    model_score: str = "model_score",
    alpha: float = HYBRID_ALPHA,
) -> DataFrame:
    """Blend the lexicon compound with a model score into sentiment_label and sentiment_confidence.

    A row without a model score counts as neutral with score 0.
    """
    score = F.coalesce(model_score, F.lit(0.0))
    label = F.lower(F.coalesce(model_label, F.lit("neutral")))
    signed = F.when(label == "positive", score).when(label == "negative", -score).otherwise(F.lit(0.0))
    h = F.lit(alpha) * F.col(compound) + F.lit(1 - alpha) * signed
    return (
        df.withColumn("_h", h)
        .withColumns(
            {
                "sentiment_label": F.when(F.col("_h") >= LABEL_CUT, "positive")
                .when(F.col("_h") <= -LABEL_CUT, "negative")
                .otherwise("neutral"),
                "sentiment_confidence": F.round(F.least(F.abs("_h"), F.lit(1.0)), 4),
                model_score: F.round(score, 4),
            }
        )
        .drop("_h")
    )


def sentiment_fallback(df: DataFrame, text_col: str = "clean") -> DataFrame:
    """Neutral label, zero scores and no flag for texts with nothing to analyse."""
    usable = tx.is_analyzable(tx.fill_text(F.col(text_col)))
    zeros = [c for c in ("sentiment_confidence", "lex_compound", "model_score", "lex_pos", "lex_neg", "lex_neu") if c in df.columns]
    out = {c: F.when(usable, F.col(c)).otherwise(F.lit(0.0)) for c in zeros}
    if "sentiment_label" in df.columns:
        out["sentiment_label"] = F.when(usable, F.col("sentiment_label")).otherwise(F.lit("neutral"))
    return df.withColumns(out)


def critical_flag(compound: Column, threshold: float = CRITICAL_BELOW) -> Column:
    """Strictly below the threshold."""
    return compound < threshold


def analyze_sentiment(
    df: DataFrame,
    text_col: str = "text",
    model=None,
    lexicon: Mapping[str, float] | None = None,
    alpha: float = HYBRID_ALPHA,
    critical_threshold: float = CRITICAL_BELOW,
    normalise: bool = True,
    max_chars: int | None = None,
) -> DataFrame:
    """Add label, confidence, compound, model score, the three shares and the critical flag to a table.

    ``model`` is a function that takes a table with a ``clean`` column and adds ``model_label`` and
    ``model_score``; without one every row takes the fallback score. ``max_chars`` limits what the model is
    given; the lexicon always reads the whole text. Works on streams as well.
    """
    original = df.columns
    df = df.withColumn("clean", tx.clean(F.col(text_col), normalise))
    df = lexicon_sentiment(df, "clean", lexicon)
    if model is not None and max_chars is not None:
        df = model(df.withColumn("_whole", F.col("clean")).withColumn("clean", F.substring("clean", 1, max_chars)))
        df = df.withColumn("clean", F.col("_whole"))
    elif model is not None:
        df = model(df)
    else:
        df = df.withColumns({"model_label": F.lit(None).cast("string"), "model_score": F.lit(None).cast("double")})
    df = sentiment_fallback(hybrid_score(df, alpha=alpha), "clean")
    df = df.withColumn("is_critical", critical_flag(F.col("lex_compound"), critical_threshold))
    return df.select(
        *original, "sentiment_label", "sentiment_confidence", "lex_compound", "model_score",
        "lex_pos", "lex_neg", "lex_neu", "is_critical",
    )


def analyze_one(spark, text: str, max_chars: int | None = None, **options) -> DataFrame:
    """The same for a single text; ``max_chars`` limits what a model is given of it."""
    return analyze_sentiment(spark.createDataFrame([(text,)], "text string"), max_chars=max_chars, **options)


def sentiment_alerts(scored: DataFrame, text_col: str = "text", id_col: str = "ticket_id") -> DataFrame:
    """Critical tickets with their scores and the beginning of the text."""
    return scored.filter("is_critical").select(
        id_col, F.col("sentiment_label").alias("label"), F.col("sentiment_confidence").alias("confidence"),
        "lex_compound", "model_score", tx.preview(tx.fill_text(F.col(text_col))).alias("preview"),
    )


def topic_sentiment_breakdown(
    scored: DataFrame, topics: list[str] | DataFrame, topic_labels: list[str] | None = None, text_col: str = "text"
) -> DataFrame:
    """Per label: mean compound, mean confidence, number of matches, label distribution.

    A few keywords are matched inside each row; a table of them (keyword, topic), of any size, is joined by its q-grams. A text
    that contains two keywords of one label counts twice.
    """
    if isinstance(topics, DataFrame):
        # What is not read further on is not moved with the matches. The rest is written, since texts are read for the index too.
        narrow = materialise(scored.select(text_col, "sentiment_label", "lex_compound", "sentiment_confidence"), "breakdown-scored")
        matches = keyword_table_matches(narrow, topics, text_col)
    else:
        matches = keyword_matches(scored, topics, topic_labels or topics, text_col)
    per_label = matches.groupBy("topic", "sentiment_label").agg(
        F.count("*").alias("n"), F.sum("lex_compound").alias("c"), F.sum("sentiment_confidence").alias("f")
    )
    return per_label.groupBy("topic").agg(
        tx.round_mean(F.sum("c") / F.sum("n")).alias("mean_compound"),
        tx.round_mean(F.sum("f") / F.sum("n")).alias("mean_confidence"),
        F.sum("n").alias("count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("sentiment_label", "n")))).alias("label_distribution"),
    )


def keyword_matches(df: DataFrame, keywords: list[str], labels: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Each row once per keyword that its text contains, ignoring case, with the label as ``topic``."""
    labels = labels or keywords
    lowered = F.lower(tx.fill_text(F.col(text_col)))
    found = F.array(
        *[F.when(F.contains(lowered, F.lit(k.lower())), F.struct(F.lit(t).alias("topic"), F.lit(k).alias("keyword")))
          for k, t in zip(keywords, labels)]
    )
    return df.select("*", F.inline(F.array_compact(found)))
