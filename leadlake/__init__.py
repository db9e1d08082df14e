"""Lead analytics as Spark jobs: map, clean, upsert, score, rank, train and monitor."""
