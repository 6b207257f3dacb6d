"""Operations of a training-data pipeline: token counts, quality rules, near-duplicate joins,
language-model scores, licence and secret scans, language identification, decontamination,
tokenizer round trips and quality classification.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame and the names of its
columns, reads only those columns, and gives its own fixed output columns, so extra columns with
clashing names never matter.
"""
