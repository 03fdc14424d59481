"""skein: a PySpark engine for preparing, searching, analysing and measuring text collections."""
