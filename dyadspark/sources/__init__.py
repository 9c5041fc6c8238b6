from dyadspark.sources.readers import (  # noqa: F401
    clean_text, read_annotation, read_community, read_csv, read_genotype_text, read_sample_metadata,
    read_tsv, read_wide_counts,
)
from dyadspark.sources.writers import (  # noqa: F401
    read_pair_table, write_community, write_csv, write_delimited, write_pair_table, write_tsv,
)
