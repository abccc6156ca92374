"""URL filters: pattern rules indexed by their rarest literal token; a URL's tokens fetch the rules that run their regular expression on it.

Rules are rows of (kind, rule, action). Kind ``host``: a host and the beginning of a path (``example.com/en/``); it fits its host, all subdomains, and paths that
start with its own; the longest fitting one decides. Kind ``pattern``: an address with ``*`` (anything), ``^`` (a character that ends a word of an address, or the end),
``|`` at either end (the address begins or ends here) and ``||`` (a host or its subdomain begins here); it decides where no host rule fits: of several, an
allowing one goes before blocking ones, then the longest. Addresses that nothing fits are allowed.

1. Every rule is turned into a regular expression and its literal tokens, runs of ``[0-9a-z]`` that the rule bounds on both sides, so that each address it fits has them whole.
2. One pass counts the addresses that hold each of the rules' tokens; a rule is indexed by its rarest one. A rule without a token is a candidate for each address.
3. Addresses are dealt out to their different tokens, these meet the index, and only the rules met run. One row for each address is shuffled.

The index is broadcast in blocks of at most ``block`` rules, one pass for each block, so it may be of any size.

Cases: a null address, or one without ``://``, has an empty host and path; patterns still see the whole address. Repeated rows are judged one by one, whatever their id.
Long addresses count whole. An empty table gives an empty table. ``keep`` returns rows with all their columns, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from marginalia.llm.util import numbered, settle, spread_join

#: Rules by host and path: the longest that fits decides.
HOST_RULES = """
allow com/
block example.com/en/
allow www.example.com/en/
block net/es/
block net/fr/
"""

#: Patterns, for addresses that no host rule fits.
PATTERNS = """
block ||cheap-pills.
block ||spam-farm.
block ||link-farm.
block ||linkfarm.
block ||free-money.
block ||buy-followers.
block ||essay-mill.
block ||*-casino.
block ||casino-
block ||casino.
block ||poker.
block ||slots.
block ||betting.
block ||porn.
block ||xxx.
block ||adult.
block ||escort.
block ||warez.
block ||keygen.
block ||torrent.
block ||torrents.
block ||payday-loans.
block ||replica-watches.
block ||viagra.
block ||cialis.
block ||doubleclick.
block ||adserver.
block ||ads.
block ||adclick.
block ||track.
block ||tracking.
block ||analytics.
block ||pixel.
block ||telemetry.
block /porn/
block /xxx/
block /casino/
block /viagra/
block /cheap-viagra
block /keygen/
block /warez/
block /torrent/
block /adserver/
block /banner-ads/
block /popunder.
block /clickbait/
block /doorway/
block /link-exchange/
block /wp-login.php
block /wp-admin/
block /xmlrpc.php
block /cgi-bin/
block /phpmyadmin/
block /trackback/
block /sessionid=
block ?jsessionid=
block ?phpsessid=
block &phpsessid=
block ;jsessionid=
block /checkout/cart/
block /user/login
block /account/signin
block ^affiliate_id=
block ^affid=
block ^clickid=
block ^redirect=http
block ^goto=http
block .exe|
block .msi|
block .dmg|
block .apk|
block .iso|
block .zip|
block .rar|
block .mp4|
block |javascript:
block |data:
block |mailto:
allow ||wikipedia.org^
allow ||wikimedia.org^
allow ||archive.org^
allow ||*.edu/
allow ||*.gov/
allow /health/addiction/
allow /research/
allow ||analytics.*/blog/
"""

BLOCK_OF_RULES = 50_000
_LOWER = (string.ascii_uppercase, string.ascii_lowercase)
_AFTER = r"^[\s\S]*?://"
_SPECIAL = r"([\\.+?()\[\]{}|$\-])"
_TOKEN = "(?<![0-9a-z*])[0-9a-z]+(?![0-9a-z*])"


def parse(lines: str, kind: str) -> list[tuple[str, str, str]]:
    """(kind, rule, action) of lines of an action and a rule."""
    return [(kind, rule, action) for action, rule in (line.split(None, 1) for line in lines.split("\n") if line.strip())]


DEFAULT = parse(HOST_RULES, "host") + parse(PATTERNS, "pattern")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = DEFAULT) -> DataFrame:
    """kind, rule, action: rules written in a program as a table."""
    names = ("kind", "rule", "action")
    if not rules:
        return spark.range(0).select(*[F.lit("").alias(n) for n in names])
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rules])))


def lower(column: Column) -> Column:
    return F.translate(column, *_LOWER)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return lower(F.coalesce(F.regexp_extract(url, _AFTER + "([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _AFTER + "[^/?#]*([^?#]*)", 1), F.lit(""))


def compiled(rules: DataFrame) -> DataFrame:
    """rank (the highest fitting one decides), kind, rule, action, regex and tokens of each different rule."""
    rule, is_host = F.col("rule"), F.col("kind") == "host"
    body = F.regexp_replace(rule, r"^\|\|?|\|$", "")
    escaped = F.regexp_replace(lower(body), _SPECIAL, r"\\$1")
    pattern = F.regexp_replace(F.regexp_replace(escaped, r"\*", "[\\\\s\\\\S]*"), r"\^", "(?:[^0-9a-z_.%\\\\-]|\\$)")
    begins = F.when(rule.startswith("||"), r"^[a-z][0-9a-z+.\-]*://(?:[^/?#]*\.)?").when(rule.startswith("|"), "^").otherwise("")
    of_host = F.concat(F.lit(r"^(?:[^/]*\.)?"), F.regexp_replace(rule, r"([\\.+*?()\[\]{}|^$\-])", r"\\$1"), F.when(rule.contains("/"), "").otherwise("(?:/|$)"))
    regex = F.when(is_host, of_host).otherwise(F.concat(begins, pattern, F.when(rule.endswith("|") & (F.length(rule) > 1), "$").otherwise("")))
    # a star marks an end at which the address may go on with letters
    open_left = F.when(is_host | rule.startswith("|"), "").otherwise("*")
    open_right = F.when(F.when(is_host, ~rule.contains("/")).otherwise(rule.endswith("|")), "").otherwise("*")
    literal = F.when(is_host, F.regexp_replace(rule, r"\*", " ")).otherwise(body)
    tokens = F.array_distinct(F.regexp_extract_all(F.concat(open_left, lower(literal), open_right), F.lit(_TOKEN), F.lit(0)))
    order = W.orderBy(is_host, ~is_host & (F.col("action") == "allow"), F.length("rule"), "rule", "action")
    return rules.where("rule IS NOT NULL").distinct().select(F.row_number().over(order).cast("long").alias("rank"), "kind", "rule", "action", regex.alias("regex"), tokens.alias("tokens"))


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(lower(url), F.lit("[0-9a-z]+"), F.lit(0)))


def rarest(rules: DataFrame, urls: DataFrame, block: int = BLOCK_OF_RULES) -> DataFrame:
    """``compiled`` rules with ``token``, the one of theirs that the fewest addresses hold (then the longest); empty if a rule has none."""
    of_rules = settle(rules.select("rank", F.explode("tokens").alias("token")), "rule_tokens")
    wanted = of_rules.select("token").distinct()
    seen = urls.select(F.explode(_tokens(F.col("url"))).alias("token"))
    counts = seen.join(F.broadcast(wanted) if wanted.count() <= block else wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    best = of_rules.join(counts, "token", "left").groupBy("rank").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.length("token")).alias("shorter"), "token")).getField("token").alias("token"))
    return rules.join(best, "rank", "left").withColumn("token", F.coalesce("token", F.lit("")))


def _judged(urls: DataFrame, rules: DataFrame, block: int) -> DataFrame:
    """``urls`` (row, page_id, url) with host, path, rule, verdict, pattern."""
    index = settle(rarest(settle(compiled(rules), "rules"), urls, block), "rule_index")
    n_rules = index.count()
    url = F.coalesce("url", F.lit(""))
    # each address meets the rules without a token by its empty token, which also keeps it where it meets none
    rows = urls.select("row", "page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), lower(url).alias("low"), F.explode(F.concat(_tokens(url), F.array(F.lit("")))).alias("token"))
    met = None
    for first in range(0, max(n_rules, 1), block):
        part = index.where((F.col("rank") > first) & (F.col("rank") <= first + block)).select("token", "rank", "kind", "regex")
        found = rows.join(F.broadcast(part), "token", "left").where("rank IS NOT NULL OR token = ''")
        met = found if met is None else met.unionByName(found)
    is_host = F.col("kind") == "host"
    fits = F.when(is_host, F.rlike(F.concat("host", "path"), F.col("regex"))).otherwise(F.rlike(F.col("low"), F.col("regex")))
    best = met.groupBy("row", "page_id", "host", "path").agg(F.max(F.when(is_host & fits, F.col("rank"))).alias("by_host"), F.max(F.when(~is_host & fits, F.col("rank"))).alias("by_pattern"))
    names = index.select("rank", "rule", "action")
    for key, rule, action in (("by_host", "rule", "host_action"), ("by_pattern", "pattern", "pattern_action")):
        own = names.select(F.col("rank").alias(key), F.col("rule").alias(rule), F.col("action").alias(action))
        best = best.join(F.broadcast(own), key, "left") if n_rules <= block else spread_join(best, own, key, "row", "left")
    return best.select("row", "page_id", "host", "path", "rule", F.coalesce("host_action", "pattern_action", F.lit("allow")).alias("verdict"), "pattern")


def annotate(pages: DataFrame, rules: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", block: int = BLOCK_OF_RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule (the host rule that fits), verdict, pattern (the best pattern that fits, whether it decides or not)."""
    urls = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return _judged(urls, rule_table(pages.sparkSession) if rules is None else rules, block).drop("row")


def keep(pages: DataFrame, rules: DataFrame | None = None, url_col: str = "url", block: int = BLOCK_OF_RULES) -> DataFrame:
    """The rows of ``pages`` whose address is allowed, with all their columns."""
    packed = numbered(pages, "pages")
    urls = packed.select("row", F.lit(None).cast("long").alias("page_id"), F.col("doc").getField(url_col).cast("string").alias("url"))
    allowed = _judged(urls, rule_table(pages.sparkSession) if rules is None else rules, block).where("verdict = 'allow'")
    return packed.join(allowed.select("row"), "row", "left_semi").select("doc.*")
