"""riskframe: scan large tables of source files, manifests and requests for risk with PySpark."""
