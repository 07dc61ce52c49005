"""Transcript annotation: metadata, representative choice, event-guided choice, splicing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condensq.functions.sequence import reverse_complement, to_rna
from condensq.operators.intervals import (
    binned_join,
    contained,
    normalise_contig,
    overlap_length,
    shrink,
)
from condensq.operators.ranking import best_per_key

MIN_OVERLAP = 10
INTRON_SLACK = 2


def transcript_meta(annotation: DataFrame) -> DataFrame:
    """Exon count, span, biotype and canonical flag per transcript.

    `ord` numbers the transcripts as annotated and settles equal scores.
    """
    attr = lambda k: F.try_element_at("attrs", F.lit(k))
    tx = F.when(F.col("feature") == "transcript", F.lit(True))
    rows = annotation.where(F.col("feature").isin("exon", "transcript")).select(
        attr("gene_id").alias("gene_id"),
        attr("transcript_id").alias("transcript_id"),
        "feature", "start", "end", "seqname", "strand",
        F.when(tx, attr("transcript_biotype")).alias("biotype"),
        F.when(tx, F.coalesce(attr("tag"), F.lit("")).contains("canonical")).alias("canonical"),
    )
    # Texts are aggregated in sorted order: lines of a transcript come together first, so a task sorts
    # its share of the transcripts and not a whole split of the file.
    return (
        rows.where("transcript_id IS NOT NULL")
        .repartition("gene_id", "transcript_id")
        .groupBy("gene_id", "transcript_id")
        .agg(
            F.count_if(F.col("feature") == "exon").alias("n_exons"),
            F.max("biotype").alias("biotype"),
            F.coalesce(F.bool_or("canonical"), F.lit(False)).alias("is_canonical"),
            F.min("seqname").alias("contig"),
            F.min("strand").alias("strand"),
            F.min("start").alias("tx_start"),
            F.max("end").alias("tx_end"),
        )
    )


def canonical_transcript(meta: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Per gene: canonical plus coding first, then exon count, then annotation order."""
    coding = (F.coalesce(F.col("biotype"), F.lit("")) == "protein_coding").cast("int")
    score = F.col("is_canonical").cast("int") + coding
    return best_per_key(
        meta, ["gene_id"], [score.alias("s1"), F.col("n_exons").alias("s2")], ord_col
    )


def region_lengths(annotation: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Summed lengths of 5' UTR, CDS and 3' UTR per transcript."""
    # Both spellings of the untranslated regions.
    kinds = {
        "utr5_length": ["five_prime_utr", "5UTR", "five_prime_UTR"],
        "cds_length": ["CDS"],
        "utr3_length": ["three_prime_utr", "3UTR", "three_prime_UTR"],
    }
    # Fixed values end.
    rows = annotation.where(F.col("feature").isin([k for v in kinds.values() for k in v]))
    rows = rows.withColumn("transcript_id", F.try_element_at("attrs", F.lit("transcript_id")))
    if targets is not None:
        rows = rows.join(targets.select("transcript_id"), "transcript_id", "left_semi")
    size = F.col("end") - F.col("start") + 1
    return rows.where("transcript_id IS NOT NULL").groupBy("transcript_id").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("feature").isin(names), size)), F.lit(0)).alias(col)
            for col, names in kinds.items()
        ]
    )


def event_matches(exons: DataFrame, events: DataFrame, width: int = 1000) -> DataFrame:
    """Distinct (gene_id, event_id, transcript_id) for transcripts that include an event's region,
    with the event's type, condition and dpsi.

    exons: gene_id, transcript_id, contig, start, end. events: gene_id, event_id, event_type,
    contig, region1_start/end, region2_start/end (1-based; the second region only for mutually
    exclusive exons, of which either will do).
    """
    ex = exons.select(
        "gene_id", "transcript_id", normalise_contig(F.col("contig")).alias("contig"),
        F.col("start").alias("l_start"), F.col("end").alias("l_end"),
    )
    ev = events.withColumn("contig", normalise_contig(F.col("contig")))
    about = ["event_type", "condition", "dpsi"]
    regions = ev.select(
        "gene_id", "event_id", "contig", *about,
        F.explode(
            F.array(
                F.struct(F.col("region1_start").alias("s"), F.col("region1_end").alias("e")),
                F.struct(F.col("region2_start").alias("s"), F.col("region2_end").alias("e")),
            )
        ).alias("r"),
    ).select(
        "gene_id", "event_id", "contig", *about,
        F.col("r.s").alias("r_start"), F.col("r.e").alias("r_end"),
    ).where("r_start IS NOT NULL AND r_end IS NOT NULL")
    retained = F.col("event_type") == "RI"
    cut = shrink(regions, F.when(retained, F.lit(INTRON_SLACK)).otherwise(F.lit(0)))
    included = F.when(retained, contained()).otherwise(overlap_length() >= MIN_OVERLAP)
    hits = binned_join(ex, cut, ["gene_id", "contig"], included, width, longest=width)
    # Dealt by transcript, as the join with transcript data is next: equal rows meet there too.
    return hits.select("gene_id", "event_id", "transcript_id", *about).repartition("transcript_id").distinct()


def first_matching_event(matches: DataFrame, meta: DataFrame) -> DataFrame:
    """Per gene the first event by falling |dpsi| that any transcript includes, and its best one.

    Ties: heat-stress events first, then event id; transcripts by canonical, coding, exons, order.
    Both choices are partial aggregates: transcripts within an event, then events within a gene.
    """
    coding = (F.coalesce(F.col("biotype"), F.lit("")) == "protein_coding").cast("int")
    by_transcript = F.struct(
        (-F.col("is_canonical").cast("int")).alias("a"), (-coding).alias("b"),
        (-F.col("n_exons")).alias("c"), F.col("ord").alias("d"),
    )
    rated = matches.join(meta.drop("gene_id"), "transcript_id")
    per_event = rated.groupBy("gene_id", "event_id", "event_type", "condition", "dpsi").agg(
        F.min_by("transcript_id", by_transcript).alias("transcript_id"),
        F.count(F.lit(1)).alias("n_candidates"),
    )
    by_event = F.struct(
        F.coalesce(-F.abs("dpsi"), F.lit(1.0)).alias("a"),
        F.when(F.col("condition") == "HS", 0).otherwise(1).alias("b"),
        F.col("event_id").alias("c"),
    )
    pick = F.struct(
        "transcript_id", "event_id", "event_type", F.col("condition").alias("event_condition"),
        "n_candidates",
    )
    chosen = per_event.groupBy("gene_id").agg(F.min_by(pick, by_event).alias("p"))
    more = F.concat(F.lit("_"), "n_candidates", F.lit("candidates"))
    source = F.concat(
        F.lit("event_"), F.col("event_type"), F.lit("_overlap"),
        F.when(F.col("n_candidates") > 1, more).otherwise(F.lit("")),
    )
    return chosen.select("gene_id", "p.*").withColumn("isoform_source", source)


def map_isoforms(
    labelled: DataFrame, events: DataFrame, exons: DataFrame, meta: DataFrame, width: int = 1000
) -> DataFrame:
    """One transcript per labelled gene: event-guided for positives, else the canonical one."""
    positives = labelled.where("class = 1").select("gene_id")
    own_events = events.join(positives, "gene_id", "left_semi")
    matches = event_matches(exons, own_events, width)
    guided = first_matching_event(matches, meta).select(
        "gene_id", F.col("transcript_id").alias("g_tx"), "event_type", "event_condition",
        "isoform_source",
    )
    counts = own_events.groupBy("gene_id").agg(F.count("*").alias("n_events"))
    fallback = canonical_transcript(meta).select("gene_id", F.col("transcript_id").alias("c_tx"))
    info = meta.select("transcript_id", "biotype", "is_canonical", "n_exons")
    out = (
        labelled.join(guided, "gene_id", "left")
        .join(counts, "gene_id", "left")
        .join(fallback, "gene_id", "left")
        .withColumns(
            {
                "transcript_id": F.coalesce("g_tx", "c_tx"),
                "isoform_source": F.coalesce("isoform_source", F.lit("canonical_fallback")),
                "n_events": F.coalesce("n_events", F.lit(0)),
            }
        )
        .where("transcript_id IS NOT NULL")
        .drop("g_tx", "c_tx")
    )
    return out.join(info, "transcript_id", "left")


def tile_contigs(contigs: DataFrame, size: int = 10_000) -> DataFrame:
    """Contig text cut into fixed tiles: (contig, tile, text), tile 0 starting at position 1."""
    n = F.greatest(F.ceil(F.length("seq") / size), F.lit(1))
    return contigs.select(
        "contig", "seq", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("tile")
    ).select(
        "contig", "tile",
        F.substring("seq", (F.col("tile") * size + 1).cast("int"), F.lit(size)).alias("text"),
    )


def spliced_sequence(exons: DataFrame, tiles: DataFrame, size: int = 10_000) -> DataFrame:
    """Transcript sequence: exon pieces in transcript order, reverse-complemented on `-`.

    exons: transcript_id, contig, strand, start, end, and exon_id if exons of one transcript may
    coincide. Pieces come from an equi join on (contig, tile); an exon that crosses tiles is put
    together again by the sort.
    """
    pieces = exons.where("end >= start").withColumn(
        "tile",
        F.explode(
            F.sequence(F.floor((F.col("start") - 1) / size), F.floor((F.col("end") - 1) / size))
        ),
    )
    lo = F.greatest(F.col("start"), F.col("tile") * size + 1)
    hi = F.least(F.col("end"), (F.col("tile") + 1) * size)
    cut = F.substring(
        F.col("text"), (lo - F.col("tile") * size).cast("int"), (hi - lo + 1).cast("int")
    )
    order = [c for c in ("start", "end", "exon_id") if c in exons.columns]
    joined = pieces.join(tiles, ["contig", "tile"]).select(
        "transcript_id", "strand", *order, lo.alias("lo"), cut.alias("piece")
    )
    # A row of the result is one sequence, so gathering its pieces is bounded by that row.
    parts = joined.groupBy("transcript_id", "strand").agg(
        F.array_sort(F.collect_list(F.struct(*order, "lo", "piece"))).alias("parts")
    )
    text = to_rna(F.array_join(F.col("parts.piece"), ""))
    return parts.select(
        "transcript_id",
        F.when(F.col("strand") == "-", reverse_complement(text)).otherwise(text).alias("seq"),
    )
