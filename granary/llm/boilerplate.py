"""Page boilerplate and main content (problem 1).

Method: wrapper induction. The pages are plain text, so a page's tree is its
root, its lines as children and each line's words as leaves; a line with a
constant opening (``Tags:``, ``See also >``) also has that opening as a node.
Labels are the letters of a line without case, so that figures, bullets and
spacing don't matter.

1. Pages of one host are dealt into groups of bounded size; the pages of a group
   are aligned one after another with the group's common tree by simple tree
   matching (the ordered matching of children of greatest weight, where nodes
   match if their labels do and a match weighs one more than its leaves), and what
   isn't matched is added to the common tree between its matched neighbours
   (partial tree alignment). Every page is aligned, and a host with a third of all
   pages just has more groups.
2. A node that is matched votes for its page's article (its title, so that a page
   scraped again doesn't vote twice). Votes are combined over all groups; nodes
   constant over at least ``min_articles`` articles and ``min_share`` of the
   host's pages form its template, nodes in the templates of ``min_hosts`` hosts
   the template of all.
3. Template nodes are boilerplate, except those that name the article's author,
   source or terms (byline and note cues). What varies is a slot. A slot of
   sentences, prices or figures is content; a short line without a sentence is a
   heading where it stands within the article, that is before its last line of
   content, else an entry of a link list. Cues for cookie, share, newsletter,
   keyword and legal lines count only for pages whose host has no template or
   that have no host. Lines of any length are nodes.

Pages without content have no lines. Pages without url have no host: for them the
template of all, slots and cues decide. Equal rows count once. Blank lines
are neither content nor boilerplate.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.operators.relational import lookup
from granary.plans.staging import stage

GROUP = 64
BODY, FIGURES, NOTE, TITLE, SHORT, CUE = range(6)
MIN_SHARE = 0.02

# fixed values: words that mark lines around an article, in French and English
FURNITURE_CUES = re.compile(
    r"""(?ix) ^\W*(?:
      (?:mots[ -]?cl[ée]s?|tags?|th[èe]mes?|keywords?|[ée]tiquettes?|rubriques?|topics?)\s*[:–—>-] | filed\s+under\b | \#\s*\w
    | (?:lire|voir)\s+(?:aussi|[ée]galement)\b | [àa]\s+lire\b | see\s+also\b | read\s+(?:also|more|next)\b | related\s*[:–—>-] | more\s+on\s+this\b
    | (?:publicit[ée]|annonce|advertisement|ad|sponsored(?:\s+content)?|contenu\s+sponsoris[ée])\W*$
    | (?:r[ée]agir|comments?|commentaires?|partag[ée]e?\s+\d+\s+fois)\W*[\d\W]*$ | \d+\s+(?:shares?|comments?|commentaires?|partages?)\W*$
    | (?:aller\s+au\s+contenu|skip\s+to\s+content|toggle\s+navigation|menu|haut\s+de\s+page|back\s+to\s+top|retour\s+en\s+haut)\W*$
    | (?:copier\s+le\s+lien|copy\s+link|partager\s+cet|share\s+this|envoyer\s+par\s+courriel|email\s*\W\s*print)
    | (?:suivez[ -]nous|follow\s+us)\b
    | (?:tout\s+)?(?:accepter|refuser)(?:\s+et\s+fermer)?\W*$ | accept\s+all\W*$ | i\s+agree\W*$ | reject\b.{0,30}$ | manage\s+(?:choices|preferences)
    | g[ée]rer\s+(?:les|mes)\s+\w+ | param[ée]trer\s+mes
    ) | ^\W*©
    """
)
# fixed values: words of cookie, legal and newsletter lines, wherever they stand
FURNITURE_WORDS = (
    "cookie", "traceurs", "témoins de connexion", "temoins de connexion", "votre vie privée", "votre vie privee", "values your privacy",
    "use of trackers", "store small files", "tous droits réservés", "tous droits reserves", "all rights reserved", "reproduction même partielle",
    "reproduction, même partielle", "no part of this page", "mentions légales", "mentions legales", "données personnelles", "donnees personnelles",
    "terms of use", "plan du site", "site map", "abonnez-vous", "abonnez vous", "inscrivez-vous", "inscrivez vous", "inscrivezvous",
    "inscrivez votre adresse", "sign up for", "enter your address", "newsletter",
)
# fixed values: words that open bylines and notes on an article
NOTE_CUES = re.compile(
    r"""(?ix) ^\W*(?:
      (?:texte|words|photos?|text|reportage|auteur|author)\s*: | (?:par|by)\s+\w+(?:\s+\S+){0,4}\W*$
    | de\s+notre\s+(?:correspondante?|envoy[ée]e?) | from\s+our\s+correspondent | propos\s+recueillis | interview\s+by | avec\s+.{3,60}\bpresse\b | with\s+.{3,60}\b(?:wire|press|agency)\b
    | cette\s+(?:chronique|rubrique)\s+est | this\s+(?:column|section)\s+is
    | (?:les\s+)?prix\s+cit[ée]s | prices\s+quoted
    | contact\s+de\b | .{0,30}\bcontact\s*:\s*\w | (?:note|nb|n\.b\.|erratum|correction)\s*:
    )
    """
)
# fixed values: what a line in which an author answers readers says
ANSWERS = re.compile(r"(?i)r[ée]pond(?:ent)?\s+aux\s+lecteurs|answers?\s+readers")
FIGURE_LINE = re.compile(r"(?i)\d[\d  .,]*\s*(?:f|fcfa|cfa|xof|€|\$|euros?|francs?|usd)\b(?:\s*(?:/|le|la|les|par|a|per)\s*\w+)?\W*$")
TRUNCATED = re.compile(r"(?i)(?:\.\.\.|…|\[[.… ]+\])\s*(?:lire la suite|read more|suite|more)?\W*$|(?:lire la suite|read more)\W*$")
SENTENCE_END = re.compile(r"[.!?][\"'»”)\]\s]*$")
OPENING = re.compile(r"^\W*([^\W\d_][^:–—>|]{1,28}?)\s*[:–—>]\s*\S")
SEPARATED = re.compile(r"\s+[|/·>›»•]\s+|\s{3,}")
NO_LETTERS = re.compile(r"[\W\d_]+")
WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def letters(s: str) -> str:
    """The letters of a line in order, without case."""
    return NO_LETTERS.sub("", s).lower()


def label(s: str) -> int:
    """A signed 64-bit label of a line's letters; 0 if it has none."""
    x = letters(s)
    return xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) if x else 0


def read_line(line: str) -> tuple[int, int, int, int, bool]:
    """(label, label of the opening, words, class, cue) of a line by itself."""
    n = len(WORDS.findall(line))
    opening = OPENING.match(line)
    head = label("opening" + letters(opening[1])) if opening else 0
    cut = TRUNCATED.search(line, max(0, len(line) - 40))
    cue = False
    low = line.lower()
    if NOTE_CUES.match(line) or ("lecteurs" in low or "readers" in low) and ANSWERS.search(line):
        kind = NOTE
    elif FIGURE_LINE.search(line, max(0, len(line.rstrip()) - 80)):
        kind = FIGURES
    else:
        row = False
        if any(c in line for c in "|/·>›»•\t") or "   " in line:
            parts = [p for p in SEPARATED.split(line.strip(" *•-")) if p.strip()]
            row = len(parts) >= 3 and all(len(WORDS.findall(p)) <= 4 for p in parts)
        sentence = n >= 6 and SENTENCE_END.search(line, max(0, len(line) - 20)) and not line.rstrip().endswith("?") or n >= 25
        kind = CUE if row else BODY if sentence and not cut else SHORT
    if kind != NOTE and kind != CUE:
        if "  " in low or "\u00a0" in low:
            low = " ".join(low.split())
        cue = FURNITURE_CUES.match(line) is not None or any(w in low for w in FURNITURE_WORDS)
    return label(line), head, min(n, 99), kind, cue


def _page_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[int, int, int, int, bool]] = {}
    for b in batches:
        lines: list[tuple] = []
        trees: list[tuple] = []
        for row, page, site, title, author, text in zip(*(c.to_pylist() for c in b.columns)):
            own = letters(title or "")
            name = letters(author or "")
            nodes, weights = [], []
            for no, line in enumerate(text.split("\n"), 1):
                if not line.strip():
                    continue
                x = known.get(line)
                if x is None:
                    x = read_line(line)
                    if len(line) <= 120:
                        if len(known) > 200_000:
                            known.clear()
                        known[line] = x
                node, head, n, kind, cue = x
                if own and kind != BODY:
                    mine = letters(line)
                    if mine == own:
                        kind = TITLE
                    elif mine.endswith(own) and len(mine) > len(own) and SEPARATED.search(line):
                        kind = CUE  # a breadcrumb ends in the title
                    elif name and len(mine) < len(name) + 40 and name in mine and kind == SHORT:
                        kind = NOTE
                lines.append((row, page, site, no, kind, cue, node, head))
                if node:
                    nodes.append(node)
                    weights.append(n)
                    if head:
                        nodes.append(head)
                        weights.append(1)
            article = label(title or "") or page
            if site is not None and nodes:
                trees.append((row, page, site, article, nodes, weights))
        cols = list(zip(*lines)) if lines else [()] * 8
        tree = list(zip(*trees)) if trees else [()] * 6
        n, m = len(lines), len(trees)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(cols[0] + tree[0], pa.int64()), pa.array(cols[1] + tree[1], pa.int64()),
                pa.array(cols[2] + tree[2], pa.string()), pa.array(cols[3] + (None,) * m, pa.int32()),
                pa.array(cols[4] + (None,) * m, pa.int8()), pa.array(cols[5] + (None,) * m, pa.bool_()),
                pa.array(cols[6] + (None,) * m, pa.int64()), pa.array(cols[7] + (None,) * m, pa.int64()),
                pa.array((None,) * n + tree[3], pa.int64()),
                pa.array((None,) * n + tree[4], pa.list_(pa.int64())), pa.array((None,) * n + tree[5], pa.list_(pa.int8())),
            ],
            ["row", "page", "site", "line_no", "kind", "cue", "node", "head", "article", "nodes", "weights"],
        )


SCHEMA = (
    "row long, page long, site string, line_no int, kind byte, cue boolean, node long, head long, article long, "
    "nodes array<long>, weights array<byte>"
)


def matching(a: list[int], wa: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of positions, last first, of the heaviest order-preserving matching of ``a`` and ``b``.

    The recurrence of simple tree matching over the children of two roots, run
    over pairs of equal labels only: best chains by last position in b.
    """
    places: dict[int, list[int]] = {x: [] for x in a}
    for j, x in enumerate(b):
        if x in places:
            places[x].append(j)
    ends: list[int] = []  # rising positions in b
    best: list[tuple[int, int]] = []  # rising (weight, chain) of those
    chains: list[tuple[int, int, int]] = []  # (position in a, position in b, previous chain)
    for i, x in enumerate(a):
        for j in reversed(places[x]):
            k = bisect_left(ends, j)
            weight, before = best[k - 1] if k else (0, -1)
            weight += 1 + wa[i]
            if k < len(ends) and ends[k] == j and best[k][0] >= weight:
                continue
            chains.append((i, j, before))
            top = k
            while top < len(ends) and best[top][0] <= weight:
                top += 1
            ends[k:top] = [j]
            best[k:top] = [(weight, len(chains) - 1)]
    out, at = [], best[-1][1] if best else -1
    while at >= 0:
        i, j, at = chains[at]
        out.append((i, j))
    return out


def simple_tree_matching(a: list[int], wa: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` that ``matching`` pairs, last first."""
    return [i for i, _ in matching(a, wa, b)]


def align(pages: list[tuple[list[int], list[int], int]]) -> set[tuple[int, int]]:
    """(node, article) of nodes matched between articles, by partial tree alignment of ``pages(nodes, weights, article)``."""
    common: list[int] = []
    owner: list[int] = []  # the article that brought each node of the common tree
    votes: set[tuple[int, int]] = set()
    for nodes, weights, article in pages:
        pairs = matching(nodes, weights, common)
        for i, j in pairs:
            if owner[j] != article:
                votes.add((nodes[i], article))
                votes.add((nodes[i], owner[j]))
        # what isn't matched comes before the next matched node
        grown, owners, last_i, last_j = [], [], 0, 0
        for i, j in [*reversed(pairs), (len(nodes), len(common))]:
            grown += common[last_j:j] + nodes[last_i:i] + common[j : j + 1]
            owners += owner[last_j:j] + [article] * (i - last_i) + owner[j : j + 1]
            last_i, last_j = i + 1, j + 1
        common, owner = grown, owners
    return votes


def _vote(g: pd.DataFrame) -> pd.DataFrame:
    """The votes of one group's pages, the largest page first."""
    pages = [(n.tolist(), w.tolist(), a) for n, w, a in zip(g["nodes"], g["weights"], g["article"].tolist())]
    order = sorted(range(len(pages)), key=lambda k: (-len(pages[k][0]), pages[k]))
    out = pd.DataFrame(list(align([pages[k] for k in order])), columns=["node", "article"]).astype("int64")
    out.insert(0, "site", [g["site"].iloc[0]] * len(out))
    return out


def template(trees: DataFrame, min_articles: int = 3, min_share: float = MIN_SHARE, min_hosts: int = 3) -> tuple[DataFrame, DataFrame]:
    """((node, everywhere, sites), (site) with a template) of ``trees(row, site, article, nodes, weights)``.

    A node in the templates of ``min_hosts`` hosts counts everywhere, so that
    ``sites`` has fewer than min_hosts entries.
    """
    sizes = trees.groupBy(F.col("site").alias("s_site")).agg(F.count("*").alias("n"))
    sizes = stage(sizes, "p1-sites")
    dealt = lookup(trees, sizes, "site", "s_site").withColumn(
        "group", F.pmod(F.xxhash64("row"), F.greatest(F.lit(1), F.round(F.col("n") / GROUP).cast("long")))
    )
    votes = dealt.groupBy("site", "group").applyInPandas(_vote, "site string, node long, article long")
    counts = votes.distinct().groupBy("site", "node").agg(F.count("*").alias("articles"))
    own = lookup(counts.where(F.col("articles") >= min_articles), sizes, "site", "s_site").where(
        F.col("articles") >= min_share * F.col("n")
    )
    own = stage(own.select("site", "node"), "p1-template")
    by_node = own.groupBy("node").agg(F.count("*").alias("hosts"), F.collect_set("site").alias("sites"))
    everywhere = F.col("hosts") >= min_hosts
    by_node = by_node.select("node", everywhere.alias("everywhere"), F.when(~everywhere, F.col("sites")).alias("sites"))
    return by_node, own.select(F.col("site").alias("t_site")).distinct()


def classify(pages: DataFrame) -> DataFrame:
    """(page, line_no, main) of each non-blank line of ``pages(page, site, title, author, text)``."""
    some = pages.where("page is not null and text is not null").select(
        F.monotonically_increasing_id().alias("row"), "page", "site", "title", "author", "text"
    )
    read = stage(some.mapInArrow(_page_batches, SCHEMA), "p1-lines")
    trees = read.where("nodes is not null").select("row", "site", "article", "nodes", "weights")
    t, hosts = template(trees)
    t = stage(t, "p1-nodes")
    x = read.where("line_no is not null").select("row", "page", "site", "line_no", "kind", "cue", "node", F.nullif("head", F.lit(0)).alias("head"))
    for at, flag in (("node", "constant"), ("head", "opened")):
        names = {"node": f"{flag}_node", "everywhere": f"{flag}_everywhere", "sites": f"{flag}_sites"}
        x = lookup(x, t.withColumnsRenamed(names), at, names["node"])
        here = F.col(names["everywhere"]) | F.array_contains(names["sites"], F.col("site"))
        x = x.withColumn(flag, F.coalesce(here, F.lit(False))).drop(*names.values())
    x = lookup(x.withColumn("_cued", F.when(F.col("cue"), F.col("site"))), hosts, "_cued", "t_site")
    cued = F.col("cue") & F.col("t_site").isNull()
    free = F.col("kind").isin(BODY, SHORT)
    role = F.when(cued | free & (F.col("constant") | (F.col("opened") & (F.col("kind") == SHORT))), CUE).otherwise(F.col("kind"))
    x = x.select("row", "page", "line_no", role.alias("role"))
    after = W.partitionBy("row").orderBy("line_no").rowsBetween(1, W.unboundedFollowing)  # the lines of one page
    page = W.partitionBy("row")
    following = F.first(F.when(F.col("role") != CUE, F.col("role")), ignorenulls=True).over(after)
    solid = F.col("role").isin(BODY, FIGURES, NOTE)
    no = F.col("line_no")
    x = x.withColumn("following", following).withColumns({
        "begins": F.min(F.when(solid | (F.col("role") == TITLE), no)).over(page), "ends": F.max(F.when(solid, no)).over(page),
        "titled": F.max(F.col("role") == TITLE).over(page),
    })
    # within the article a short line is a heading; right before it, where no line is known to be the title, the title
    title = ~F.col("titled") & (no < F.col("begins")) & F.col("following").isin(BODY, FIGURES, NOTE)
    heading = (no > F.col("begins")) & (no < F.col("ends"))
    main = solid | (F.col("role") == TITLE) | ((F.col("role") == SHORT) & (title | heading))
    return x.select("page", "line_no", F.coalesce(main, F.lit(False)).alias("main"))


def boilerplate_lines(pages: DataFrame) -> DataFrame:
    """(page, line_no): the non-blank lines that aren't main body."""
    return classify(pages).where(~F.col("main")).select("page", "line_no").distinct()
