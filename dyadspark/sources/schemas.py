"""Column names and types of the text inputs. Types are stated, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# The header of a sample metadata file, with the name and type used here.
# "day" is a date written dd/MM/yyyy; "flag" is TRUE/FALSE.
SAMPLE_METADATA = [
    ("SampleID", "sample_id", "string"),
    (".sample", "ord", "int"),
    ("BreedGroupID", "group_id", "bigint"),
    ("FieldPeriodID", "period_id", "bigint"),
    ("sample.id", "sample_id_2", "string"),
    ("BirdID", "bird_id", "bigint"),
    ("TubeNumber", "tube_number", "int"),
    ("OriginalSampleIDUnique", "original_sample_id", "string"),
    ("season", "season", "string"),
    ("SequencingRun", "sequencing_run", "int"),
    ("CatchID", "catch_id", "bigint"),
    ("OccasionID", "occasion_id", "bigint"),
    ("BTO", "bto_ring", "string"),
    ("FieldRing", "field_ring", "string"),
    ("CatchTerritoryID", "catch_territory_id", "bigint"),
    ("SampleDate", "sample_date", "day"),
    ("SampleYear", "year", "int"),
    ("FreezerDate3", "freezer_date", "day"),
    ("Timeinfridge", "time_in_fridge", "int"),
    ("SampleType", "sample_type", "string"),
    ("SampleType4Way", "sample_type4", "string"),
    ("ExtractionDate", "extraction_date", "day"),
    ("Qubit", "qubit", "double"),
    ("BirthDate", "birth_date", "day"),
    ("SexEstimate", "sex", "int"),
    ("SampleTime", "sample_time", "string"),
    ("CatchTime", "catch_time", "int"),
    ("Ageclass", "age_class", "string"),
    ("AgeDays", "age_days", "int"),
    ("SamplingAge", "sampling_age", "double"),
    ("EyeColour", "eye_colour", "string"),
    ("BreedTerritoryNumber", "breed_territory_no", "double"),
    ("BreedTerritoryID", "breed_territory_id", "bigint"),
    ("Status", "role", "string"),
    ("TQcorrected", "tq", "double"),
    ("averageTQ_SameType", "tq_avg", "double"),
    ("TQnotes_SameType", "tq_notes", "string"),
    ("TQFinal_SameType", "tq_final", "double"),
    ("FieldPeriodID_LastSeen", "last_seen_period_id", "bigint"),
    ("LastPeriodSeenDate", "last_seen_date", "day"),
    ("LastBreedYearSeen", "last_breed_year", "int"),
    ("DaysToLastSeen", "days_to_last_seen", "int"),
    ("DiedEver", "died_ever", "string"),
    ("BirthDateEstimated", "birth_date_estimated", "flag"),
    ("SampleReads", "sample_reads", "bigint"),
    ("is.negLab", "is_neg_lab", "flag"),
    ("is.negCollection", "is_neg_collection", "flag"),
    ("MeanTQ_FP", "tq_mean_period", "double"),
    ("MeanCentredTQ", "tq_centred", "double"),
    ("Status2", "status2", "string"),
    ("Ageclass2", "age_class2", "string"),
    ("YrsToLastSeen", "years_to_last_seen", "double"),
    ("TerminalYear", "terminal_year", "string"),
    ("Timeinfridge_scaled", "time_in_fridge_scaled", "double"),
    ("CatchTime_scaled", "catch_time_scaled", "double"),
    ("TQcorrected_scaled", "tq_scaled", "double"),
    ("n_members", "n_members", "int"),
    ("seasonstgt", "seasons_together", "int"),
    ("HelperPresent", "helper_present", "string"),
    ("FledglingPresent", "fledgling_present", "string"),
    ("TerritoryID", "territory_id", "bigint"),
]

# Fixed values: (file name, own name, type) of the smaller inputs.
BREEDING_STATUS = [
    ("BreedGroupID", "group_id", "bigint"),
    ("BirdID", "bird_id", "bigint"),
    ("Status", "role", "string"),
    ("StatusID", "status_id", "bigint"),
]
GROUP_LOCATION = [
    ("BreedGroupID", "group_id", "bigint"),
    ("FieldPeriodID", "period_id", "bigint"),
    ("TerritoryID", "territory_id", "bigint"),
]
OFFSPRING = [
    ("OffID", "off_id", "bigint"),
    ("Parent", "parent", "bigint"),
    ("SpouseID", "spouse_id", "bigint"),
    ("Confidence", "confidence", "double"),
    ("BirthDate", "birth_date", "day"),
]
RELATEDNESS = [
    ("IID1", "bird_a", "bigint"),
    ("IID2", "bird_b", "bigint"),
    ("R.ped", "relatedness", "double"),
]
GENOTYPES = [
    ("BirdID", "ind", "bigint"),
    ("Locus", "locus", "string"),
    ("Method", "method", "string"),
    ("AlleleA", "a", "int"),
    ("AlleleB", "b", "int"),
]
TAXONOMY = [
    ("TaxonID", "taxon_id", "string"),
    ("Kingdom", "kingdom", "string"),
    ("Phylum", "phylum", "string"),
    ("Class", "class", "string"),
    ("Order", "order", "string"),
    ("Family", "family", "string"),
    ("Genus", "genus", "string"),
]


def text_schema(columns) -> T.StructType:
    """Everything as text, in file order: values are cleaned before they are typed."""
    return T.StructType([T.StructField(file_name, T.StringType()) for file_name, _, _ in columns])
