"""The job queue as a fold over events, in batch and as a stream."""
