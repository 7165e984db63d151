"""plans of the media-stream library."""
