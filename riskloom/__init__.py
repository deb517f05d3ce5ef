"""Transaction-risk analytics as Spark jobs: rules, features, anomaly scores, alerts, audit and drift."""
