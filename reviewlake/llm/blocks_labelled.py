"""The labelled table from which the tree of ``html_text`` is trained, written by hand.

One line a block, in the order of its page: page, content or not (1, 0), the elements around it with their classes, its words, and
how many of them are in links. Pages are laid out as news, blogs, shops, forums, manuals and old tables lay theirs out.
"""

LABELLED = """
plain 0 nav/ul/li 1 1
plain 0 nav/ul/li 1 1
plain 0 nav/ul/li 2 2
plain 0 div.ad 7 0
plain 1 article/h1 9 0
plain 1 article/p 31 0
plain 1 article/p 1 0
plain 1 article/p 120 2
plain 1 article/p 5 0
plain 1 article/p 2 0
plain 0 footer 11 0
short 0 nav/ul/li 1 1
short 0 div.ad 12 2
short 1 article/h1 5 0
short 1 article/p 4 0
short 0 footer 9 0
news 0 header/div 3 3
news 0 header/nav/ul/li 1 1
news 0 header/nav/ul/li 1 1
news 0 div.cookie-notice/p 34 2
news 0 div.cookie-notice/button 2 0
news 1 main/article/header/h1 11 0
news 1 main/article/p 48 0
news 1 main/article/figure/figcaption 12 0
news 1 main/article/p 66 4
news 1 main/article/h2 4 0
news 1 main/article/p 9 0
news 1 main/article/blockquote/p 22 0
news 1 main/article/p 71 0
news 0 main/article/div.share/ul/li 1 1
news 0 main/article/div.share/ul/li 1 1
news 0 main/article/aside/h3 2 0
news 0 main/article/aside/ul/li 8 8
news 0 main/article/footer/p 14 3
news 0 main/section.comments/h2 2 0
news 0 main/section.comments/div/p 44 0
news 0 main/section.comments/div/p 17 0
news 0 main/section.comments/form/label 3 0
news 0 aside.sidebar/h3 2 0
news 0 aside.sidebar/ul/li 7 7
news 0 aside.sidebar/ul/li 9 9
news 0 aside.sidebar/p 40 0
news 0 footer/p 26 6
news 0 footer/ul/li 1 1
list 1 article/h1 6 0
list 1 article/p 38 0
list 1 article/ul/li 6 0
list 1 article/ul/li 3 1
list 1 article/ul/li 11 0
list 1 article/ol/li 2 0
list 1 article/table/tr/td 1 0
list 1 article/table/tr/td 3 0
list 1 article/p 25 24
list 0 article/p 4 4
list 0 article/ul.related/li 6 6
list 0 footer 15 0
blog 0 div/a 2 2
blog 0 div/ul/li 1 1
blog 0 div/ul/li 1 1
blog 0 div/ul/li 2 2
blog 1 div/div/h1 7 0
blog 1 div/div/p 41 1
blog 1 div/div/p 12 0
blog 1 div/div/p 88 5
blog 1 div/div/h2 3 0
blog 1 div/div/p 60 0
blog 1 div/div/p 18 0
blog 1 div/div/p 33 0
blog 0 div/div/ul/li 4 4
blog 0 div/div/ul/li 5 5
blog 0 div/div/h3 2 0
blog 0 div/div/ul/li 6 6
blog 0 div/div/ul/li 5 5
blog 0 div/div/p 8 2
soup 0 div/span 2 2
soup 0 div/span 1 1
soup 0 div/span 3 3
soup 1 div/h1 8 0
soup 1 div/p 55 0
soup 1 div/p 29 2
soup 1 div/p 6 0
soup 1 div/p 71 0
soup 1 div/p 15 0
soup 0 div/p 9 9
soup 0 div/p 5 0
soup 0 div/p 4 3
old 0 table/tr/td 4 4
old 0 table/tr/td 2 2
old 0 table/tr/td 3 3
old 1 table/tr/td/h2 5 0
old 1 table/tr/td 140 3
old 1 table/tr/td/p 93 0
old 1 table/tr/td/p 24 0
old 0 table/tr/td 6 5
old 0 table/tr/td 7 0
shop 0 div.menu/ul/li 2 2
shop 0 div.menu/ul/li 1 1
shop 0 form/label 2 0
shop 1 main/h1 5 0
shop 1 main/div/p 64 0
shop 1 main/div/p 7 0
shop 1 main/div/ul/li 5 0
shop 0 main/div.newsletter/p 19 0
shop 0 main/div.newsletter/form/p 9 0
shop 0 main/div.related/h2 3 0
shop 0 main/div.related/p 16 2
shop 0 footer/div/p 31 2
forum 0 div.breadcrumb/a 3 3
forum 1 main/article/h1 9 0
forum 1 main/article/p 84 0
forum 1 main/article/p 3 0
forum 0 main/div.comment/p 52 0
forum 0 main/div.comment/p 8 0
forum 0 main/div.comment/p 103 4
forum 0 div.login/p 6 1
manual 0 nav/ol/li 3 3
manual 0 nav/ol/li 4 4
manual 1 main/h1 3 0
manual 1 main/p 21 2
manual 1 main/h2 2 0
manual 1 main/p 57 6
manual 1 main/pre 30 0
manual 1 main/ul/li 9 2
manual 1 main/h2 1 0
manual 1 main/p 4 0
manual 0 main/p 3 3
manual 0 main/p 2 2
manual 0 footer/p 10 4
promo 0 div.banner/p 23 1
promo 0 div.popup/p 37 1
promo 1 article/h1 8 0
promo 1 article/p 45 0
promo 0 article/div.ad/p 21 2
promo 1 article/p 52 1
promo 0 article/div.promo/p 33 4
promo 1 article/p 8 0
promo 0 article/p.tags 5 5
promo 0 div.subscribe/p 28 0
bare 1 h1 6 0
bare 1 p 80 0
bare 1 p 14 0
bare 1 p 45 1
links 0 ul/li 3 3
links 0 ul/li 4 4
links 0 ul/li 4 4
links 0 p 5 4
links 0 p 3 0
links 0 p 6 6
note 0 div/p 4 0
note 0 div/p 6 6
note 1 div/p 26 0
note 1 div/p 47 0
note 0 div/p 3 3
brief 0 nav/ul/li 1 1
brief 0 nav/a 6 6
brief 1 article/h1 4 0
brief 1 article/p 3 0
brief 1 article/p 1 0
brief 0 footer 5 1
brief2 0 nav/ul/li 3 3
brief2 1 main/h1 2 0
brief2 1 main/p 6 0
brief2 0 footer 8 0
brief3 0 div/ul/li 2 2
brief3 0 div/a 3 3
brief3 1 article/p 2 0
brief3 1 article/p 5 0
brief3 1 article/p 4 0
brief4 0 header/a 2 2
brief4 1 article/div/h2 3 0
brief4 1 article/div/p 8 1
brief4 0 article/p 3 3
brief4 1 article/p 7 0
brief4 1 article/p 2 0
brief4 0 article/ul/li 3 3
brief4 0 article/ul/li 2 2
brief4 1 article/p 5 0
brief4 0 footer/p 4 0
cites 1 article/h2 1 0
cites 1 article/ul/li 16 14
cites 1 article/ul/li 22 19
cites 1 article/p 18 17
cites 1 article/ul/li 12 11
cites 1 article/p 6 2
index 0 div/ul/li 9 9
index 0 div/ul/li 12 12
index 0 div/ul/li 14 14
index 0 div/p 18 17
index 0 div/p 25 23
index 0 div/ul/li 11 10
index 0 div/p 8 7
index 0 div/p 6 0
teaser 0 div/h3 8 8
teaser 0 div/p 9 1
teaser 0 div/h3 10 10
teaser 0 div/p 12 2
teaser 0 div/h3 9 9
teaser 0 div/p 3 3
guide 1 article/h1 3 0
guide 0 article/ul/li 8 8
guide 0 article/ul/li 7 7
guide 1 article/p 6 0
guide 0 article/ul/li 6 6
guide 1 article/p 40 0
guide 0 article/ul/li 9 9
guide 1 article/p 12 0
guide 0 article/p 10 10
guide 1 article/h2 2 0
guide 0 article/p 5 5
guide2 0 nav/a 12 12
guide2 1 main/p 3 0
guide2 0 main/p 8 8
guide2 1 main/p 21 0
guide2 0 main/p 7 7
guide2 1 main/p 5 0
guide2 0 main/ul/li 6 6
guide3 0 div/ul/li 8 8
guide3 0 div/p 3 0
guide3 0 div/ul/li 9 9
guide3 0 div/p 6 0
guide3 0 div/ul/li 7 7
guide3 0 div/p 5 0
diary 0 div/ul/li 2 2
diary 1 div/h1 5 0
diary 1 div/p 14 0
diary 1 div/p 19 0
diary 1 div/h2 2 0
diary 1 div/p 22 0
diary 1 div/p 11 0
diary 1 div/h2 4 0
diary 1 div/p 17 1
diary 0 div/h3 2 0
diary 0 div/p 3 3
diary2 0 div/p 2 0
diary2 1 div/h1 6 0
diary2 1 div/p 20 0
diary2 1 div/h3 4 0
diary2 1 div/p 15 0
diary2 0 div/p 3 0
end 0 nav/a 5 5
end 1 article/p 20 0
end2 0 nav/ul/li 1 1
end2 1 main/p 3 0
end3 0 div/ul/li 3 3
end3 1 div/p 60 0
end4 0 nav/ul/li 2 2
end4 1 article/h1 6 0
end4 0 article/p 9 9
end4 1 article/p 11 0
end5 0 header/p 6 6
end5 1 article/p 1 0
"""
