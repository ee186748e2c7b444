"""URL filters: explicit rules, then empirical-Bayes host reputation; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise, ref

#: Rules: verdict, host, path.
RULES: tuple[tuple[str, str, str], ...] = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Standard deviations below the posterior mean at which the bound lies.
DEVIATIONS = 1.645
#: Least and most pseudo-observations that a prior counts for.
STRENGTH = (2.0, 1000.0)
#: Public suffixes of several labels, a fixed selection of the public suffix list: second levels of country domains.
_SECOND_LEVELS = {
    "ae": "ac co gov mil net org sch",
    "ar": "com edu gob gov int mil net org tur",
    "at": "ac co gv or",
    "au": "asn com edu gov id net org",
    "bd": "com net org edu gov ac mil",
    "br": "adm art blog com edu eco eng gov ind jus leg mil net org tv",
    "cn": "ac com edu gov mil net org",
    "co": "com edu gov mil net nom org",
    "ec": "com edu gob gov mil net org",
    "eg": "com edu eun gov mil name net org sci",
    "es": "com edu gob nom org",
    "fr": "asso com gouv nom prd tm",
    "hk": "com edu gov idv net org",
    "hu": "co",
    "id": "ac co desa go mil my net or sch web",
    "il": "ac co gov idf k12 muni net org",
    "in": "ac co edu firm gen gov ind mil net nic org res",
    "it": "edu gov",
    "jp": "ac ad co ed go gr lg ne or",
    "ke": "ac co go info me mobi ne or sc",
    "kr": "ac co es go hs kg mil ms ne or pe re sc",
    "mt": "com edu gov net org",
    "mx": "com edu gob gov net org",
    "my": "com edu gov mil name net org",
    "ng": "com edu gov i mil mobi name net org sch",
    "nz": "ac co cri geek gen govt health iwi maori mil net org parliament school",
    "pe": "com edu gob mil net nom org",
    "ph": "com edu gov ngo net org",
    "pk": "com org net edu gov",
    "pt": "com edu gov net nome org publ",
    "qa": "com net org edu gov",
    "sa": "com edu gov med net org pub sch",
    "sg": "com edu gov net org per",
    "th": "ac co go in mi net or",
    "tr": "av bbs bel biz com dr edu gen gov info k12 kep mil name net org pol tel tv web",
    "tw": "club com edu game gov idv mil net org",
    "ua": "com edu gov in kiev kharkov lviv net odessa org",
    "uk": "ac co gov ltd me net nhs org plc police sch",
    "uy": "com edu gub mil net org",
    "ve": "com edu gob gov mil net org web",
    "vn": "ac com edu gov health info int name net org pro",
    "za": "ac co edu gov law mil net nom org school web",
}
SUFFIXES: tuple[str, ...] = tuple(f"{x}.{country}" for country, levels in _SECOND_LEVELS.items() for x in levels.split())


def _lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parse(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty where it is null or has no ``://``."""
    start = F.locate("://", url)
    has = F.coalesce(start > 0, F.lit(False))
    rest = F.substr(url, start + 3)
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.when(has, _lower(host)).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def judged(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent of it and begins the path; else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _name(host: Column) -> Column:
    """A host without user, port and closing dot."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"\A.*@", ""), r":[0-9]*\z", ""), r"\.\z", "")


def _labels(host: Column, more: int, suffixes: tuple[str, ...]) -> Column:
    """The public suffix of a host and ``more`` labels before it; an IP address is whole."""
    name = _name(host)
    address = name.startswith("[") | name.rlike(r"\A[0-9]{1,3}(\.[0-9]{1,3}){3}\z")
    out = F.when(address, name)
    for n in sorted({x.count(".") + 1 for x in suffixes}, reverse=True):  # the longest match first
        out = out.when(F.substring_index(name, ".", -n).isin([x for x in suffixes if x.count(".") + 1 == n]), F.substring_index(name, ".", -n - more))
    return out.otherwise(F.substring_index(name, ".", -1 - more))


def registered(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The registered domain: the public suffix of a host and the label before it."""
    return _labels(host, 1, suffixes)


def suffix(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The public suffix: the longest of ``suffixes`` that ends the host, else its last label."""
    return _labels(host, 0, suffixes)


LEVELS = ("suffix", "domain", "host")


def _strengths(counts: DataFrame) -> dict[str, tuple[float, float]]:
    """Moment estimates over the units of each level: the mean share of bad pages and the prior's pseudo-observations.

    With shares p_i of n_i pages around the mean m, the variance between units is
    what exceeds the binomial part; the strength is m(1 - m) over it, less 1.
    """
    units = counts.where("seen > 0").select("seen", "bad", F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(x).alias("unit")) for x in LEVELS])).alias("u"))
    units = units.groupBy("u.level", "u.unit").agg(F.sum("bad").alias("bad"), F.sum("seen").alias("seen"))
    sums = units.groupBy("level").agg(F.sum("bad").alias("bad"), F.sum("seen").alias("seen"), F.sum(F.col("seen") * F.col("seen")).alias("squares"), F.sum(F.col("bad") * F.col("bad") / F.col("seen")).alias("weighed"), F.count("*").alias("many"))
    out = dict.fromkeys(LEVELS, (0.0, STRENGTH[1]))
    for row in sums.collect():  # three rows
        bad, seen, squares, weighed, many = (float(row[c]) for c in ("bad", "seen", "squares", "weighed", "many"))
        mean = bad / seen
        within, size = mean * (1 - mean), seen - squares / seen
        between = (weighed - seen * mean * mean - (many - 1) * within) / size if size > 0 else 0.0
        strength = within / between - 1 if between > 0 else STRENGTH[1]
        out[row["level"]] = mean, min(max(strength, STRENGTH[0]), STRENGTH[1])
    return out


def reputations(outcomes: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(host, bad: 0 or 1, null where unlabelled) -> (host, seen, bad, share, bound, mean), one row a host.

    Priors run from all pages to the suffix, the registered domain and the host: at each
    level the parent's posterior mean counts as many pages as the moment estimate of
    that level says.  ``share`` is the host's posterior mean, ``bound`` that many
    deviations below it, ``mean`` the share of all labelled pages.  A host without labels has
    its domain's share.  Outcomes are read once: hosts are counted and written, and all
    levels are sums over them.
    """
    counts = outcomes.groupBy("host").agg(F.count("bad").alias("seen"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    counts = materialise(counts.withColumn("domain", registered(F.col("host"), suffixes)).withColumn("suffix", suffix(F.col("host"), suffixes)), "hosts")
    (mean, of_suffix), (_, of_domain), (_, of_host) = (_strengths(counts)[x] for x in LEVELS)

    def posterior(prior: Column, strength: float, bad: Column, seen: Column) -> Column:
        return (prior * F.lit(strength) + bad) / (F.lit(strength) + seen)

    domains = counts.groupBy("suffix", "domain").agg(F.sum("bad").alias("d_bad"), F.sum("seen").alias("d_seen"))
    of_suffixes = domains.groupBy("suffix").agg(F.sum("d_bad").alias("s_bad"), F.sum("d_seen").alias("s_seen"))
    domains = domains.join(of_suffixes, "suffix").withColumn("s_share", posterior(F.lit(mean), of_suffix, F.col("s_bad"), F.col("s_seen"))).withColumn("d_share", posterior(F.col("s_share"), of_domain, F.col("d_bad"), F.col("d_seen"))).select("domain", "d_share")
    hosts = counts.join(domains, "domain")
    share = posterior(F.col("d_share"), of_host, F.col("bad"), F.col("seen"))
    deviation = F.sqrt(share * (1 - share) / (F.lit(of_host + 1) + F.col("seen")))
    return hosts.select("host", "seen", "bad", share.alias("share"), (share - F.lit(DEVIATIONS) * deviation).alias("bound"), F.lit(mean).alias("mean"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", outcome_id: str = "doc_id", good_col: str = "quality", rules: tuple[tuple[str, str, str], ...] = RULES, threshold: float | None = None, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Rows of ``pages`` -> (page_id, host, path, rule, verdict, host_share, host_bound).

    ``outcomes`` labels some pages by id (``good_col`` 1 good, 0 bad; others unlabelled).  An
    explicit rule decides first; else a host is blocked when the lower bound of its
    share of bad pages is above ``threshold`` or, without one, above the share of all
    labelled pages: when it is surely worse than the average.  A null url, or one without ``://``, has an
    empty host, which has a reputation like any other.  Several labels of one page
    count once, as bad if any says so; repeated pages are judged and count each; null ids have no
    label; empty tables give empty tables, and without labels every page is allowed.  Other
    columns are ignored, whatever their names; urls of any length are read whole.
    """
    host, path = parse(ref(url_col).cast("string"))
    rows = pages.select(ref(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    labels = outcomes.select(ref(outcome_id).cast("long").alias("page_id"), F.when(ref(good_col) == 0, 1).when(ref(good_col) == 1, 0).alias("bad")).where("bad is not null and page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    known = reputations(rows.join(labels, "page_id", "left").select("host", "bad"), suffixes)
    rule, verdict = judged(F.col("host"), F.col("path"), rules)
    found = rows.join(known, "host")
    worse = F.col("bound") > (F.lit(threshold) if threshold is not None else F.col("mean"))
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(worse, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), F.col("share").alias("host_share"), F.col("bound").alias("host_bound"))
