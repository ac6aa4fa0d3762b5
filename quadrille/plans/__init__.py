"""Plans of several Spark jobs: solving positions backwards, and tables in the shared folder."""
