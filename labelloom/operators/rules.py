"""Labelling rules as data: what must be present, what must be absent, which class it votes.

A rule is a boolean expression over the lexicon signals of a text.  ``RULES`` is the preset of
forty rules over fourteen lexicons; the lexicons themselves are supplied by the user.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.operators.lexicon import Lexicons, count, flag, lexicon_signals

ABSTAIN = -1


@dataclass(frozen=True)
class Rule:
    """Votes ``vote`` when all of ``needs`` and one of ``any_of`` occur and none of ``without``.

    ``entries`` = (lexicons, n) asks for at least n distinct entries over those lexicons;
    ``kinds`` = (lexicons, n) for at least n of the lexicons; ``max_words`` bounds the length.
    ``where`` is an escape hatch: any Column, including an Arrow UDF of the text.
    """

    name: str
    vote: int
    needs: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    entries: tuple[tuple[str, ...], int] | None = None
    kinds: tuple[tuple[str, ...], int] | None = None
    max_words: int | None = None
    where: Callable[[], Column] | None = None

    def condition(self) -> Column:
        parts = [F.col(flag(n)) for n in self.needs]
        if self.any_of:
            parts.append(reduce(Column.__or__, [F.col(flag(n)) for n in self.any_of]))
        parts += [~F.col(flag(n)) for n in self.without]
        if self.entries:
            names, least = self.entries
            parts.append(reduce(Column.__add__, [F.col(count(n)) for n in names]) >= least)
        if self.kinds:
            names, least = self.kinds
            hits = [F.col(flag(n)).cast("int") for n in names]
            parts.append(reduce(Column.__add__, hits) >= least)
        if self.max_words is not None:
            parts.append(F.col("word_count") <= self.max_words)
        if self.where is not None:
            parts.append(self.where())
        return reduce(Column.__and__, parts) if parts else F.lit(True)

    def ballot(self) -> Column:
        return F.when(self.condition(), F.lit(self.vote)).otherwise(F.lit(ABSTAIN)).cast("tinyint")


def counted_lexicons(rules: Sequence[Rule]) -> set[str]:
    return {n for r in rules if r.entries for n in r.entries[0]}


def apply_rules(
    df: DataFrame, text: str, lexicons: Lexicons, rules: Sequence[Rule], keep: Sequence[str]
) -> DataFrame:
    """Columns ``keep`` plus ``votes``: one tinyint per rule, in rule order.  No shuffle."""
    signals = lexicon_signals(df, text, lexicons, counted_lexicons(rules))
    return signals.select(*keep, F.array(*[r.ballot() for r in rules]).alias("votes"))


def votes_long(votes: DataFrame, rules: Sequence[Rule], keep: Sequence[str]) -> DataFrame:
    """One row per text and rule."""
    names = F.array(*[F.lit(r.name) for r in rules])
    # The outer form: for the inner one Spark adds a filter on the array, which it then pushes
    # down and evaluates in full a second time.
    return votes.select(*keep, F.posexplode_outer("votes").alias("rule", "vote")).select(
        *keep, "rule", F.element_at(names, F.col("rule") + 1).alias("rule_name"), "vote"
    )


# --------------------------------------------------------------------------- fixed values
HATE, OFFENSIVE, NEUTRAL = 0, 1, 2
LABEL_NAMES = ["HATE", "OFFENSIVE", "NEUTRAL"]

LEXICONS = (
    "tribal_slurs", "tribal_names", "political_slurs", "dehumanizing", "violence_incitement",
    "profanity", "insults", "threats", "news", "humanitarian", "violence_reporting",
    "war_parties", "dialect", "religious",
)
(TS, TN, PS, DH, VI, PF, IN, TH, NW, HM, VR, WP, DI, RL) = LEXICONS
NEGATIVE = (TS, TN, PS, DH, VI, PF, IN, TH, RL)
CONTEXT = (NW, VR, WP, HM)

RULES = (
    Rule("lf_tribal_slur_dehumanizing", HATE, needs=(TS, DH)),
    Rule("lf_tribal_slur_profanity", HATE, needs=(TS, PF)),
    Rule("lf_tribal_slur_violence", HATE, needs=(TS, VI)),
    Rule("lf_tribal_slur_always", HATE, needs=(TS,)),
    Rule("lf_tribal_name_dehumanizing", HATE, needs=(TN, DH)),
    Rule("lf_tribal_name_profanity", HATE, needs=(TN, PF)),
    Rule("lf_tribal_name_violence", HATE, needs=(TN, VI)),
    Rule("lf_political_dehumanizing", HATE, needs=(PS, DH)),
    Rule("lf_political_profanity", HATE, needs=(PS, PF)),
    Rule("lf_political_violence", HATE, needs=(PS, VI)),
    Rule("lf_violence_incitement_alone", HATE, needs=(VI,)),
    Rule("lf_multiple_tribal_slurs", HATE, entries=((TS,), 2)),
    Rule("lf_dehumanizing_violence", HATE, needs=(DH, VI)),
    Rule("lf_religious_violence", HATE, needs=(RL, VI)),
    Rule("lf_religious_dehumanizing", HATE, needs=(RL, DH)),
    Rule("lf_threats_group", HATE, needs=(TH,), any_of=(TN, TS, PS)),
    Rule("lf_multi_hate_signals", HATE, kinds=((TS, DH, VI, PF, TH), 3)),
    Rule("lf_klb_with_group", HATE, needs=(DH,), any_of=(TN, PS, WP)),
    Rule("lf_profanity_warparty_hate", HATE, needs=(PF, WP, IN)),
    Rule("lf_profanity_no_group", OFFENSIVE, needs=(PF,), without=(TS, TN, PS)),
    Rule("lf_insults_alone", OFFENSIVE, needs=(IN,)),
    Rule("lf_threats_no_group", OFFENSIVE, needs=(TH,), without=(TN, TS)),
    Rule("lf_dehumanizing_no_group", OFFENSIVE, needs=(DH,), without=(TS, TN, PS)),
    Rule("lf_profanity_insults", OFFENSIVE, needs=(PF, IN)),
    Rule("lf_religious_no_violence", OFFENSIVE, needs=(RL,), without=(VI, DH)),
    Rule("lf_multi_profanity", OFFENSIVE, entries=((PF,), 2)),
    Rule("lf_political_slur_at_least_offensive", OFFENSIVE, needs=(PS,)),
    Rule("lf_insults_overrides_neutral", OFFENSIVE, needs=(IN, DI)),
    Rule("lf_news_no_hate", NEUTRAL, needs=(NW,), without=(PF, TS, DH, IN, PS)),
    Rule("lf_humanitarian_no_hate", NEUTRAL, needs=(HM,), without=(PF, TS, VI, DH)),
    Rule("lf_reporting_plus_news", NEUTRAL, needs=(VR, NW), without=(TS, PF)),
    Rule("lf_war_party_news", NEUTRAL, needs=(WP, NW), without=(PF, TS, DH)),
    Rule("lf_dialect_no_hate", NEUTRAL, needs=(DI,), without=NEGATIVE),
    Rule("lf_no_negative_with_positive", NEUTRAL, any_of=(DI, HM), without=NEGATIVE),
    Rule("lf_short_clean", NEUTRAL, max_words=8, without=NEGATIVE + CONTEXT),
    Rule("lf_humanitarian_dialect", NEUTRAL, needs=(HM, DI), without=NEGATIVE),
    Rule("lf_reporting_no_hate", NEUTRAL, needs=(VR,), without=(PF, TS, DH, VI, IN, PS)),
    Rule("lf_tribal_name_news", NEUTRAL, needs=(TN, NW), without=(PF, DH, VI)),
    Rule("lf_hate_overrides_news", HATE, needs=(NW,), entries=((TS, DH, VI), 2)),
    Rule("lf_dehumanizing_standalone_offensive", OFFENSIVE, needs=(DH,), without=(NW,)),
)
# --------------------------------------------------------------------------- end fixed values
