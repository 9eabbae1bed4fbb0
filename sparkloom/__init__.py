"""sparkloom: documents to question-answer data sets, on Spark."""
