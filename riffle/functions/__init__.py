"""functions of the media-stream library."""
