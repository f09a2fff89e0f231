"""Financial-crime and blockchain-forensics analytics as plain Spark DataFrame operators."""
