"""corpusql: text-to-SQL corpus preparation and evaluation on Spark DataFrames.

Layout
------
functions/  Column -> Column expressions (SQL text, prompt text, token arrays)
sources/    schemas, readers, writers, database registry
operators/  DataFrame -> DataFrame operators (catalog, corpus, profiling,
            prompting, matching, execution, metrics, batches)
plans/      end-to-end jobs (convert, inspection, evaluate, training),
            driver-table fixtures, registered queries and their SQL oracles
llm/        operators of a training-data pipeline; nothing else imports it
streaming/  Structured Streaming variant of the running metrics
"""

__version__ = "0.1.0"
