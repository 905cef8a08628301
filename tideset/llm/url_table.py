"""The small labelled URL table from which the URL filter learns: single URLs, written and labelled by hand, of hosts that are not in the tables."""

# URLs to block, and URLs to allow.
BLOCK = """
http://www.royal-casino-club.example.com/en/slots
https://m.casinopalace.example.net/de/1204
http://blog.mycasino24.example.org/bonus?ref=aff
https://grand-casino-online.example.com/fr/77.html
http://m.poker-night.example.net/en/tables/5
https://texaspokerstars.example.org/join
http://bets-today.example.com/en/3301#odds
https://blog.sportsbetting-tips.example.net/es/412
http://www.livebets.example.org/de/8
https://bet-and-go.example.com/en/910?page=2
http://m.jackpot-city.example.net/spin.html
https://bigjackpots.example.com/en/14/
http://slots-of-gold.example.org/fr/2203
https://blog.roulette-room.example.com/play
http://lotterywinners.example.net/en/655?utm_source=feed
https://win-a-phone.example.org/claim
http://www.winbig.example.com/de/4471.html
https://instant-win.example.net/en/93
http://youwin-prizes.example.com/es/18#top
https://m.prize-draw.example.org/en/2057
http://blog.free-gifts.example.net/fr/631/
https://getfreecoins.example.com/en/7720
http://m.freestuff4u.example.org/de/316?ref=x
https://www.free-trials.example.com/en/45.html
http://all-for-free.example.net/offer
https://blog.bonus-codes.example.org/es/5118
http://dailybonus.example.com/en/263
https://m.cheap-watches.example.net/de/89?page=3
http://blog.cheapmeds.example.org/en/1440
https://www.cheap-flights-deal.example.com/fr/706.html
http://cheaptramadol.example.net/buy
https://m.pills-direct.example.org/en/3912
http://blog.dietpills.example.com/es/57#top
https://www.bluepills-shop.example.net/en/820
http://slimming-pills.example.com/de/6104/
https://viagra-online.example.org/order.html
http://buyviagra.example.net/en/11
https://canadian-pharmacy-rx.example.com/fr/2981
http://m.pharma-rx.example.org/en/408?ref=x
https://no-prescription-meds.example.net/de/75
http://m.adult-videos.example.com/en/1502
https://www.adultchat.example.org/es/683
http://blog.my-adult-friend.example.net/fr/4/
https://m.xxx-movies.example.com/en/9921.html
http://xxxcams.example.org/live
https://blog.hot-cams.example.net/en/350
http://porn-tube.example.com/de/8217
https://freeporn.example.org/en/64?page=2
http://escort-girls.example.net/fr/129
https://hookup-tonight.example.com/en/5540#top
http://m.ads-network.example.org/en/2?ref=x
https://blog.popads.example.net/click/771
http://www.ads-serve.example.com/de/6320
https://banner-ads.example.org/en/48.html
http://adserver7.example.net/r/90
https://m.track-clicks.example.com/en/1133
http://ad-tracker.example.org/fr/205
https://clicktrack.example.net/go?u=1
http://tracking-pixel.example.com/en/7/
https://redirect-me.example.org/out/312
http://popunder.example.net/es/44
https://blog.spam-kings.example.com/en/619
http://www.spamlinks.example.org/de/2470
https://m.link-farm.example.net/en/83?page=4
http://backlink-farm.example.com/fr/5006
https://buy-backlinks.example.org/en/127.html
http://blog.seo-boost.example.net/order
https://cheap-seo.example.com/en/942
http://buy-followers.example.org/es/31
https://getlikesfast.example.net/en/6608#top
http://m.payday-cash.example.com/de/154
https://quick-loans.example.org/en/2719
http://badcreditloan.example.net/apply
https://blog.replica-bags.example.com/fr/408/
http://replicawatch.example.org/en/5213
https://crackz-and-keygen.example.net/en/70
http://warez-world.example.com/de/3395
https://m.serial-keys.example.org/en/812?ref=x
http://miracle-weightloss.example.net/es/26
https://make-money-fast.example.com/en/4102
""".split()
ALLOW = """
http://www.city-library.example.com/en/opening
https://library.example.net/de/1187
http://townmuseum.example.org/exhibits?page=2
https://museum-of-glass.example.com/fr/64.html
http://greenhill-school.example.net/en/news/5
https://uni-harwick.example.org/join
http://physics-dept.example.com/en/2910#top
https://hospital-trust.example.net/es/431
http://www.dental-care.example.org/de/9
https://health-council.example.com/en/877?page=2
http://garden-club.example.net/plants.html
https://rosegarden.example.com/en/15/
http://bakery-lane.example.org/fr/2318
https://homebaking.example.com/recipes
http://slowcooking.example.net/en/612?utm_source=feed
https://railway-times.example.org/claim
http://www.harbourferry.example.com/de/4390.html
https://bus-and-tram.example.net/en/96
http://airport-info.example.com/es/21#top
https://cycling-routes.example.org/en/2140
http://mountain-huts.example.net/fr/655/
https://birdwatch.example.com/en/7613
http://forest-walks.example.org/de/322?ref=x
https://www.rivers-trust.example.com/en/41.html
http://weather-station.example.net/offer
https://tide-tables.example.org/es/5207
http://astronomy-club.example.com/en/274
https://starmaps.example.net/de/93?page=3
http://geology-notes.example.org/en/1399
https://www.math-circle.example.com/fr/718.html
http://chess-league.example.net/play
https://football-results.example.org/en/3870
http://rowingclub.example.com/es/52#top
https://www.village-church.example.net/en/806
http://parish-records.example.com/de/6021/
https://family-history.example.org/order.html
http://old-photos.example.net/en/12
https://town-archive.example.com/fr/2894
http://castle-ruins.example.org/en/415?ref=x
https://theatre-royal.example.net/de/78
http://orchestra.example.com/en/1466
https://www.folkmusic.example.org/es/690
http://film-society.example.net/fr/6/
https://poetry-corner.example.com/en/9834.html
http://bookbinders.example.org/live
https://second-hand-books.example.net/en/361
http://dictionary.example.com/de/8120
https://wordorigins.example.org/en/68?page=2
http://grammar-help.example.net/fr/133
https://languages-online.example.com/en/5482#top
http://docs-python.example.org/en/3?ref=x
https://kernel-mailing.example.net/click/764
http://www.open-atlas.example.com/de/6255
https://maps-and-charts.example.org/en/47.html
http://ham-radio.example.net/r/88
https://local-radio.example.com/en/1120
http://evening-herald.example.org/fr/211
https://thenewsroom.example.net/go?u=1
http://parliament-watch.example.com/en/8/
https://planning-office.example.org/out/305
http://water-board.example.net/es/46
https://solar-coop.example.com/en/628
http://www.craft-market.example.org/de/2411
https://woolshop.example.net/en/84?page=4
http://ceramics-studio.example.com/fr/4987
https://farmers-market.example.org/en/125.html
http://farm-shop.example.net/order
https://beekeeping.example.com/en/951
http://vet-clinic.example.org/es/33
https://insurance-advice.example.net/en/6572#top
http://credit-union.example.com/de/161
https://law-centre.example.org/en/2688
http://citizens-advice.example.net/apply
https://scout-group.example.com/fr/402/
http://marathon-runners.example.org/en/5164
https://camping-lakes.example.net/en/73
http://seaside-hotel.example.com/de/3342
https://hostel-north.example.org/en/820?ref=x
http://clockmakers.example.net/es/27
https://kitchen-table.example.com/en/4088
http://brennickel.example.org/en/1
https://m.marlowen.example.com/fr/588
http://www.thornberg.example.net/de/2206/
https://blog.ottersha.example.com/en/71?page=2
http://kestion.example.org/es/930.html
https://inthera.example.net/en/4415
http://www.eronsted.example.com/fr/16#top
https://m.tharnon.example.org/de/702
http://blog.lionsha.example.net/en/3158
https://wrenthal.example.com/en/240?utm_source=feed
http://ondersta.example.org/fr/8001
https://www.hedtion.example.net/en/55.html
http://m.ostrithe.example.com/de/1290
https://blog.reansholt.example.org/es/347/
http://athering.example.net/en/6719
https://nandest.example.com/fr/82
http://www.essenth.example.org/en/2533?ref=x
https://m.horenty.example.net/de/409
http://blog.thelwick.example.com/en/11
https://stonthly.example.org/fr/5870#top
http://anderly.example.net/en/194
https://www.ithenor.example.com/de/7426.html
http://m.edisthon.example.org/en/638
https://blog.nterwell.example.net/es/20
http://thistlea.example.com/en/3917/
https://oranth.example.org/fr/276
http://www.therwold.example.net/en/8450?page=2
https://m.shandel.example.com/de/103
http://blog.tientham.example.org/en/5021
https://wherstead.example.net/fr/368.html
http://ingrenth.example.com/en/49
https://www.ouserby.example.org/de/2774
http://m.handrel.example.net/en/916#top
https://blog.erantis.example.com/es/62
http://thandor.example.org/en/7305
https://entishor.example.net/fr/141/
http://www.blethen.example.com/de/830
https://m.ratheby.example.org/en/4469?ref=x
http://blog.stianor.example.net/en/27
https://lythern.example.com/fr/690
""".split()
