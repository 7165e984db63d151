"""operators of the media-stream library."""
