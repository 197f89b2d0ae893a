"""Headline text as Column expressions: cleaning, tokens, n-grams and the named token pipelines.

Everything here stays inside code generation or Spark's own array functions; ``(?U)`` gives the Unicode meaning of ``\\w``.
"""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Callable
from functools import partial, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# These lists, their order and their patterns decide results, so they equal the reference's.
REPLACEMENTS: list[tuple[str, str]] = [
    ("“", '"'),
    ("”", '"'),
    ("’", "'"),
    ("‘", "'"),
    ("—", "--"),
    ("–", "--"),
    ("−", "--"),
    ("Just now", ""),
    (r"updated \d+[Mm] ago", " "),
    (r"about \d+ hours? ago", " "),
    (r"updated \d+[Hh] ago", " "),
    (r"posted \d+ hours? ago", " "),
    (r"posted \d+ minutes? ago", " "),
    (r"\d+[Mm] ago", " "),
    (r"\d+[Hh] ago", " "),
    (r"\d+ hours? ago", " "),
    (r"\d+ minutes? ago", " "),
    (r"\d+ hrs? ago", " "),
    (r"\d+ days? ago", " "),
    (r"\d+ mins? ago", " "),
    ("<br>", " "),
    ("<br/>", " "),
    ("<br />", " "),
    ("­", " "),
    (" ", " "),
    ("\n", " "),
    ("\t", " "),
    ("\r", " "),
    (r"(?U)\s+", " "),
]
PATRONYMS = "mc mac van von de la le el al di da du del della delle delli dello".split()
CAMEL_EXEMPT = "mRNA .com .io .net .org .gov .edu .mil .int .tv .uk .us iPhone U.S. U.S.A. U.K. TikTok".split()
CONTRACTIONS = {
    "aren't": "are not",
    "can't": "cannot",
    "couldn't": "could not",
    "didn't": "did not",
    "doesn't": "does not",
    "don't": "do not",
    "hadn't": "had not",
    "hasn't": "has not",
    "haven't": "have not",
    "he'd": "he would",
    "he'll": "he will",
    "he's": "he is",
    "I'd": "I would",
    "I'll": "I will",
    "I'm": "I am",
    "I've": "I have",
    "isn't": "is not",
    "it's": "it is",
    "she'd": "she would",
    "she'll": "she will",
    "she's": "she is",
    "shouldn't": "should not",
}
TOKEN_EXPANSIONS = {"re": "are", "s": "is", "t": "not", "d": "would", "ll": "will"}
URL_DATES = {"slash_date": r"/\d{4}/\d{1,2}/\d{1,2}/", "slash_month": r"/\d{4}/\d{1,2}/", "numbers_html": r"\d+\.html", "dash_date": r"\d{4}-\d{1,2}-\d{1,2}", "dash_numbers": r"-\d+$"}

#: A small English stop list of our own; callers pass the list they use as data.
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from "
    "further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself of off on once only or other our ours out over "
    "own same she should so some such than that the their theirs them then there these they this those through to too under until up very was we were what when where which while who "
    "whom why will with you your yours"
).split()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row: lambdas would else compute it anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def remove_stops(text: Column | str) -> Column:
    """Ordered replacements; order matters, white space collapses last.

    Literals are replaced as such. The phrases about time all end in `` ago``: their patterns run only over texts with it.
    """

    def fold(c: Column, rules: list[tuple[str, str]]) -> Column:
        for old, new in rules:
            literal = not set(old) & set(r"\\?()+*[]")
            c = F.replace(c, F.lit(old), F.lit(new)) if literal else F.regexp_replace(c, F.lit(old), F.lit(new))
        return c

    ago = [k for k, (old, _) in enumerate(REPLACEMENTS) if old.endswith(" ago")]
    first, last = ago[0], ago[-1] + 1
    timed = let(fold(_col(text), REPLACEMENTS[:first]), lambda c: F.when(F.contains(c, F.lit(" ago")), fold(c, REPLACEMENTS[first:last])).otherwise(c))
    return fold(timed, REPLACEMENTS[last:])


def words(text: Column | str) -> Column:
    """White-space separated words, without empty ones."""
    return F.filter(F.split(_col(text), r"(?U)\s+"), lambda w: w != "")


def strip_story_attributions(text: Column | str) -> Column:
    """A photo or wire credit in the place of a headline becomes empty."""
    text = _col(text)
    getty = text.endswith("/Getty Images") & (F.size(words(text)) == 3)
    ap = text.endswith("/ AP") & (F.size(words(F.regexp_replace(text, "/ AP$", ""))) == 2)
    reuters = text.startswith("Reuters/") & (F.size(words(text)) == 2)
    return F.when(getty | ap | reuters, F.lit("")).otherwise(text)


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\.+|\.+$", ""), r"(?U)^\s+|\s+$", "")


def preprocess(text: Column | str) -> Column:
    return _trimmed(remove_stops(strip_story_attributions(text)))


def split_camelcases(text: Column | str) -> Column:
    """Words glued together by lost tags are parted, but for exempt words and family names."""

    def part(w: Column) -> Column:
        camel = F.regexp_replace(w, "([a-z])([A-Z])", "$1 $2")
        exempt = reduce(lambda a, b: a | b, [F.contains(w, F.lit(x)) for x in CAMEL_EXEMPT])
        name = F.lower(F.split_part(camel, F.lit(" "), F.lit(1))).isin(PATRONYMS)
        return F.when(exempt | name, w).otherwise(F.regexp_replace(camel, "([?!.:;,])([a-zA-Z])", "$1 $2"))

    return F.array_join(F.transform(words(text), part), " ")


def legacy_preprocess(text: Column | str) -> Column:
    return _trimmed(split_camelcases(remove_stops(strip_story_attributions(text))))


def strip_ie_conditionals(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"(?s)\[if.*?\].*\[endif\]", "")


def strip_raw_json(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"(?s)\{.*?\}", "")


def clean_href(href: Column | str, base: Column | str) -> Column:
    """An absolute address: protocol-relative, root-relative and bare paths are resolved against ``base``."""
    href, root = _col(href), F.regexp_replace(_col(base), "^/+|/+$", "")
    full = F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(root, href)).when(~href.startswith("http"), F.concat(root, F.lit("/"), href)).otherwise(href)
    return F.regexp_replace(full, r"(?U)^\s+|\s+$", "")


def is_url(href: Column | str) -> Column:
    """http(s) with a dotted host and no white space: the grammar we pin for the valid-address filter."""
    return _col(href).rlike(r"^https?://[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+(:\d+)?([/?#]\S*)?$")


def many_words(title: Column | str) -> Column:
    """At least one space character."""
    return F.instr(_col(title), " ") > 0


def matches_any(text: Column | str, keywords: list[str]) -> Column:
    """LIKE '%word%' for any keyword, without case."""
    low = F.lower(_col(text))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(k.lower())) for k in keywords], F.lit(False))


def format_title(title: Column | str, most: int = 128) -> Column:
    """Without quotes, cut to ``most`` characters and an ellipsis."""
    plain = F.translate(_col(title), "\"'", "")
    return F.when(F.length(plain) > most, F.concat(F.substring(plain, 1, most), F.lit("..."))).otherwise(plain)


def slug(name: Column | str) -> Column:
    return F.concat(F.replace(_col(name), F.lit(" "), F.lit("_")), F.lit(".html"))


def in_context(text: Column | str, word: str, width: int = 35) -> Column:
    """Keyword in context: up to ``width`` characters on either side."""
    return F.regexp_extract_all(_col(text), F.lit(f".{{0,{width}}} {word} .{{0,{width}}}"), F.lit(0))


def paragraphs(text: Column | str) -> Column:
    return F.split(_col(text), r"(?U)[.?!]\s*\n")


# Token arrays.


def tokenize(text: Column | str) -> Column:
    """Runs of word characters and hyphens with a letter in them; bare numbers are dropped."""
    return F.regexp_extract_all(_col(text), F.lit(r"(?U)[\w-]*\p{L}[\w-]*"), F.lit(0))


def remove_stop(tokens: Column, stopwords: list[str] = STOPWORDS) -> Column:
    low = [w.lower() for w in stopwords]
    return F.filter(tokens, lambda t: ~F.lower(t).isin(low))


def _mapped(tokens: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(pairs, t), t))


def expand_contractions(tokens: Column) -> Column:
    return _mapped(tokens, CONTRACTIONS)


def decontract(tokens: Column) -> Column:
    return _mapped(tokens, TOKEN_EXPANSIONS)


def ngrams(tokens: Column, n: int = 2, sep: str = " ", stopwords: list[str] | None = None) -> Column:
    """Sliding n-grams; those with a stop word (exact match) are left out."""

    def grams(t: Column) -> Column:
        steps = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1))).otherwise(F.array().cast("array<int>"))
        made = F.transform(steps, lambda i: F.slice(t, i, n))
        if stopwords:
            made = F.filter(made, lambda g: ~F.exists(g, lambda w: w.isin(stopwords)))
        return F.transform(made, lambda g: F.array_join(g, sep))

    return let(tokens, grams)


def stop_list(words: list[str], include: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """A stop list in lower case: the given words with more of them and without some."""
    out = {w.lower() for w in [*words, *(include or [])]} - {w.lower() for w in exclude or []}
    return sorted(out)


# Words that the word cloud leaves out besides the usual ones ("may,june" is one entry, as it is there).
CLOUD_WORDS = (
    "say said says n't mr ms mrs time year week month years life day thing something number system video months group home effort product part cup jan feb mar apr jun jul aug sep sept oct nov dec company companies "
    "business ’ ' \" go new january february march april may,june july august september october november december people subscribe est read news york images politics newsletter ago live updates exclusive producers hour"
).split()
CLOUD_STOPWORDS = stop_list(STOPWORDS, [*CLOUD_WORDS, *string.ascii_lowercase, *string.punctuation])
TOPIC_PAGE_STOPWORDS = stop_list(STOPWORDS, ["ago"])


def _suffix_lemma(t: Column) -> Column:
    return (
        F.when(t.rlike("(ss|us|is)$") | (F.length(t) < 4), t)
        .when(t.endswith("ies"), F.regexp_replace(t, "ies$", "y"))
        .when(t.rlike("(ches|shes|xes|zes|sses)$"), F.regexp_replace(t, "es$", ""))
        .when(t.endswith("men"), F.regexp_replace(t, "men$", "man"))
        .when(t.endswith("s"), F.regexp_replace(t, "s$", ""))
        .otherwise(t)
    )


def lemmatize(tokens: Column, lemma: dict[str, str] | Callable[[Column], Column] | None = None) -> Column:
    """Dictionary forms of tokens. ``lemma`` is a table of the caller (token -> lemma, others stay) or a function of a token
    array; without one, plural nouns by suffix rules stand in for a dictionary."""
    if callable(lemma):
        return lemma(tokens)
    if lemma is not None:
        return _mapped(tokens, lemma)
    return F.transform(tokens, _suffix_lemma)


#: Part-of-speech tags that are kept: nouns.
NOUNS = ("NN", "NNS", "NNP", "NNPS")


def pos_filter(tokens: Column, tagger=None, keep: tuple[str, ...] = NOUNS) -> Column:
    """Tokens whose part of speech is kept. ``tagger`` is a fitted :class:`broadsheet.operators.tagger.Tagger`, which tags a
    batch at once, or a function from a token list to its tags; without one all tokens stay."""
    if tagger is None:
        return tokens
    kept = frozenset(keep)
    if hasattr(tagger, "tag"):

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def filtered(parts: pd.Series) -> pd.Series:
            lists = [None if t is None else list(t) for t in parts]
            return pd.Series([None if t is None else [w for w, x in zip(t, tags) if x in kept] for t, tags in zip(lists, tagger.tag(lists))], dtype=object)

        return filtered(tokens)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def tagged(parts: pd.Series) -> pd.Series:
        return parts.map(lambda t: [w for w, tag in zip(t, tagger(list(t))) if tag in kept], na_action="ignore")

    return tagged(tokens)


@F.pandas_udf(T.StringType())
def normal_form(texts: pd.Series) -> pd.Series:
    """Unicode normal form C, which Spark has no function for."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def _without_marks(texts: pd.Series) -> pd.Series:
    def plain(t: str) -> str:
        return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)))

    return texts.map(plain, na_action="ignore")


_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def join_hyphenated(text: Column) -> Column:
    """A word broken over a line end is joined."""
    return F.regexp_replace(text, r"(?U)(\w{2,})-\s*\n\s*(\w{2,})", "$1$2")


def plain_quotes(text: Column) -> Column:
    return F.translate(text, "“”„‟«»‘’‚‛‹›`´", "\"\"\"\"\"\"''''''''")


def plain_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[​﻿]", ""), r"(?U)[^\S\n]+", " "))


def remove_accents(text: Column, all_scripts: bool = False) -> Column:
    """Letters without accents: those of Latin-1 in the JVM, or of all scripts by decomposition in an Arrow function."""
    return _without_marks(text) if all_scripts else F.translate(text, _ACCENTED, _PLAIN)


def remove_brackets(text: Column) -> Column:
    return F.regexp_replace(text, r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}", "")


def remove_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\p{P}", " ")


def prepare(text: Column | str, pipeline: list[Callable[[Column], Column]]) -> Column:
    """Left fold of transforms."""
    return reduce(lambda c, f: f(c), pipeline, _col(text))


#: The named pipelines; they differ in order, so they are kept apart.
DEFAULT_PIPELINE = [join_hyphenated, plain_quotes, normal_form, plain_space, remove_accents, remove_brackets, remove_punctuation, F.lower, tokenize, decontract]
TOPIC_PIPELINE = [F.lower, join_hyphenated, plain_quotes, remove_accents, remove_brackets, remove_punctuation, tokenize, expand_contractions, lemmatize, remove_stop]
CLUSTER_PIPELINE = [F.lower, join_hyphenated, plain_quotes, plain_space, remove_accents, remove_brackets, remove_punctuation, tokenize, expand_contractions, remove_stop, lemmatize]
CLOUD_PIPELINE = [join_hyphenated, plain_quotes, plain_space, remove_accents, remove_brackets, remove_punctuation, tokenize, expand_contractions, partial(remove_stop, stopwords=CLOUD_STOPWORDS), lemmatize, pos_filter]
TOPIC_PAGE_PIPELINE = [join_hyphenated, plain_quotes, plain_space, remove_accents, remove_brackets, remove_punctuation, tokenize, expand_contractions, partial(remove_stop, stopwords=TOPIC_PAGE_STOPWORDS), lemmatize]


def cloud_pipeline(tagger) -> list[Callable[[Column], Column]]:
    """The pipeline of the word cloud with a fitted tagger: of its words only nouns are left."""
    return [*CLOUD_PIPELINE[:-1], partial(pos_filter, tagger=tagger)]


PIPELINES = {"default": DEFAULT_PIPELINE, "topic": TOPIC_PIPELINE, "cluster": CLUSTER_PIPELINE, "cloud": CLOUD_PIPELINE, "topic_page": TOPIC_PAGE_PIPELINE}
