"""Command line: measures archives and reports on text logs of crawls.

    python -m webgauge -hash ARCHIVE OUT          resource and link lines of an archive
    python -m webgauge -dists A B                 distances of the urls in both captures
    python -m webgauge -redun A                   duplicate histogram
    python -m webgauge -diver A                   diversity
    python -m webgauge -size A B                  relative size
    python -m webgauge -indegree A [DOMAIN]       in-degrees
    python -m webgauge -graphSections A DOMAIN    sections by links (all heads)
    python -m webgauge -graphSectionsUrl A DOMAIN sections by links that extend the url (top heads)
    python -m webgauge -graphSectionsPart A DOMAIN sections by the closest top head
    python -m webgauge -sectionsBc A DOMAIN       sections by breadcrumb
    python -m webgauge -secDiver | -secDiverBc A DOMAIN        diversity of each section
    python -m webgauge -secDists | -secDistsBc A B DOMAIN      changes of each section

A and B are logs or folders of logs.  -hash reports the numbers of records and bytes, and of those that are HTML, on the error stream.
Exit codes: 0 success, 1 input or output error, 2 bad arguments, 3 out of memory.
"""

from __future__ import annotations

import sys

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, reports
from .plans import extract
from .plans.scratch import table
from .sources import hashlog, warc

ALIASES = {
    "-distances": "-dists", "-redundancy": "-redun", "-diversity": "-diver", "-sectionDiversity": "-secDiver", "-sectionDiversityBreadcrumb": "-secDiverBc",
    "-sectionsDistances": "-secDists", "-sectionsDistancesBc": "-secDistsBc",
}
ARGUMENTS = {
    "-hash": (2, 2), "-dists": (2, 2), "-redun": (1, 1), "-diver": (1, 1), "-size": (2, 2), "-indegree": (1, 2), "-graphSections": (2, 2), "-graphSectionsUrl": (2, 2), "-graphSectionsPart": (2, 2),
    "-sectionsBc": (2, 2), "-secDiver": (2, 2), "-secDiverBc": (2, 2), "-secDists": (3, 3), "-secDistsBc": (3, 3),
}


def load(spark: SparkSession, path: str, pages_only: bool = False) -> DataFrame:
    return table(hashlog.parse_resources(hashlog.read_lines(spark, path), pages_only, pages_only))


def sections(spark: SparkSession, path: str, info: DataFrame, domain: str, how: str) -> DataFrame:
    """(section_head, url) by ``all``, ``url``, ``part`` or ``breadcrumb``."""
    if how == "breadcrumb":
        return graph.sections_by_breadcrumb(info)
    vertices, edges = graph.web_graph(hashlog.parse_links(hashlog.read_lines(spark, path)), info)
    heads = table(graph.section_heads(vertices, edges, domain))
    if how != "all":
        heads = table(graph.top_heads(heads))
    return (graph.sections_by_distance if how == "part" else graph.sections_by_links)(vertices, edges, heads)


def report(spark: SparkSession, command: str, args: list[str]) -> DataFrame | None:
    """The result of a command; None for one that writes files."""
    command = ALIASES.get(command, command)
    if command == "-hash":
        records = table(warc.read_warc(spark, args[0]))
        hashlog.write(extract.resources(records), extract.links(records), args[1])
        print(" ".join(f"{k}={v}" for k, v in extract.run_counters(records).first().asDict().items()), file=sys.stderr)
        return None
    if command == "-dists":
        return reports.distances(load(spark, args[0]), load(spark, args[1])).orderBy("distance", "url")
    if command == "-redun":
        return reports.duplicate_histogram(load(spark, args[0])).orderBy("category", "copies")
    if command == "-diver":
        return reports.diversity(load(spark, args[0]))
    if command == "-size":
        return reports.size(load(spark, args[0]), load(spark, args[1]))
    if command == "-indegree":
        info = load(spark, args[0], True)
        vertices, edges = graph.web_graph(hashlog.parse_links(hashlog.read_lines(spark, args[0])), info, args[1] if len(args) > 1 else None)
        return graph.indegrees(vertices, edges).select("url", "indegree").orderBy(F.desc("indegree"), "url")
    how = {"-graphSections": "all", "-graphSectionsPart": "part", "-sectionsBc": "breadcrumb", "-secDiverBc": "breadcrumb", "-secDistsBc": "breadcrumb"}.get(command, "url")
    infos = [load(spark, path, True) for path in args[:-1]]
    members = [table(graph.members_info(sections(spark, path, info, args[-1], how), info.drop("section"))) for path, info in zip(args[:-1], infos, strict=True)]
    if command.startswith("-secDists"):
        return reports.changed_share(reports.distances(*members, by=("section_head",)), ("section_head",)).orderBy("section_head")
    if command.startswith("-secDiver"):
        return reports.diversity(members[0], by=("section_head",)).orderBy("section_head")
    return members[0].select("section_head", "url").orderBy("section_head", "url")


def main(argv: list[str]) -> int:
    command = ALIASES.get(argv[0], argv[0]) if argv else ""
    low, high = ARGUMENTS.get(command, (1, 0))
    if not low <= len(argv) - 1 <= high:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("webgauge").getOrCreate()
    try:
        found = report(spark, command, argv[1:])
        if found is not None:
            print("\t".join(found.columns))
            for row in found.toLocalIterator():
                print("\t".join("-" if v is None else str(v) for v in row))
    except (MemoryError, PySparkException, Py4JError, OSError) as e:
        print((str(e).splitlines() or [type(e).__name__])[0], file=sys.stderr)
        if isinstance(e, MemoryError) or "OutOfMemoryError" in str(e):
            return 3
        if isinstance(e, (AnalysisException, OSError)):
            return 1
        raise
    return 0
